"""A minimal acyclic transducer from words to the ids of their tokens.

States with the same future are one state, so suffixes are shared. Every transition carries the
number of words it skips; the sum along a word is its place among the sorted words, which names
its ids. The whole is a few numpy arrays in one block of bytes that is memory-mapped.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_FIELDS = ("keys", "targets", "weights", "final", "id_start", "ids")


def build(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``words`` as bytes."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is a word, ((byte, state), ...))
    counts: list[int] = []  # words reachable

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[s] for _, s in arcs))
        return register[key]

    # The path of the last word, not yet settled: (is a word, settled arcs).
    path: list[list] = [[False, []]]
    last = b""
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        for k in range(len(path) - 1, common, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[k - 1], settle(final, arcs)))
        if word is not None:
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
    root = settle(*path[0])
    # The root becomes state 0.
    name = {root: 0}
    for s in range(len(states)):
        name.setdefault(s, len(name))
    keys, targets, weights, final = [], [], [], np.zeros(len(states), np.uint8)
    for s, (is_word, arcs) in enumerate(states):
        final[name[s]] = is_word
        skipped = int(is_word)
        for byte, target in arcs:
            keys.append(name[s] * 256 + byte)
            targets.append(name[target])
            weights.append(skipped)
            skipped += counts[target]
    by = np.argsort(np.array(keys, np.int64))
    ids = [words[w] for w in ordered]
    arrays = [np.array(keys, np.int64)[by], np.array(targets, np.int64)[by], np.array(weights, np.int64)[by], final.astype(np.int64),
              np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([i for x in ids for i in x], np.int64)]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A transducer made by ``build``, mapped into memory from an unnamed file that vanishes with the process."""

    def __init__(self, data: bytes) -> None:
        file = tempfile.TemporaryFile()
        file.write(data)
        file.flush()
        view = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        sizes, at = view[:len(_FIELDS)], len(_FIELDS)
        for field, size in zip(_FIELDS, sizes, strict=True):
            setattr(self, field, view[at:at + size])
            at += size

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, or None; all words walk together, one byte a step."""
        out: list[np.ndarray | None] = [None] * len(words)
        if not words or not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        alive = np.flatnonzero(lengths > 0)
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            key = state[alive] * 256 + data[begin[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            alive, arc = alive[known], arc[known]
            state[alive] = self.targets[arc]
            place[alive] += self.weights[arc]
            step += 1
            ended = lengths[alive] == step
            for i in alive[ended & (self.final[state[alive]] == 1)]:
                out[i] = self.ids[self.id_start[place[i]]:self.id_start[place[i] + 1]]
            alive = alive[~ended]
        return out
