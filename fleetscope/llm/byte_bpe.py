"""Byte-level BPE by a public tokenizer file: pieces of a text, exact merges, decoding."""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass

import numpy as np
import regex

from fleetscope.llm.lexicon import Lexicon

# Fixed value: how texts are cut into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII characters.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
# Pieces a task remembers before it begins anew.
MEMORY = 400_000
# Longer pieces are merged with a heap; the others in rows of these widths, many at a time.
SHORT = 40
WIDTHS = (8, 16, SHORT)
# No merge.
_NONE = 1 << 62
_HALF = 32
_LOW = (1 << _HALF) - 1


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: bytes of each id, merges by pair of ids, special texts, odd characters."""

    byte_ids: list[int]
    id_bytes: dict[int, bytes]
    pairs: np.ndarray  # the two ids of each merge in one number, sorted
    made: np.ndarray  # its rank and the id it makes
    special: dict[str, int]
    odd: str


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    added = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("added tokens that strip or match by word are not supported")
    characters, ids = byte_characters(), model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    # A pair that is listed twice has its last rank.
    merges = {ids[a] << _HALF | ids[b]: rank << _HALF | ids[a + b] for rank, (a, b) in enumerate(pairs)}
    keys = np.array(sorted(merges), np.int64)
    id_bytes = {i: bytes(characters[c] for c in t) for t, i in ids.items()} | {t["id"]: t["content"].encode() for t in added}
    byte_ids = [ids[c] for c, _ in sorted(characters.items(), key=lambda x: x[1])]
    return Vocabulary(byte_ids, id_bytes, keys, np.array([merges[k] for k in keys.tolist()], np.int64), {t["content"]: t["id"] for t in added}, _odd_characters(spec))


def _odd_characters(spec: dict) -> str:
    """A pattern of the characters that the library, of an older Unicode version, calls neither letter nor number."""
    from tokenizers import Tokenizer

    # How texts are cut does not depend on the vocabulary, which would take much of the driver's memory.
    bare = spec | {"added_tokens": [], "model": spec["model"] | {"vocab": {}, "merges": []}}
    cut = Tokenizer.from_str(json.dumps(bare)).pre_tokenizer.pre_tokenize_str
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    odd = []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if (letter.match(c) and len(cut("a" + c)) > 1) or (number.match(c) and len(cut("1" + c)) > 1):
            odd.append(code)
    ranges: list[list[int]] = []
    for code in odd:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def merge(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of the lowest rank, the leftmost first, until none is left."""
    if len(ids) > SHORT:
        return _merge_long(ids, merges)
    none = (1 << 60, 0)
    pairs = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best is none:
            break
        k = pairs.index(best)
        ids[k:k + 2] = [best[1]]
        del pairs[k]
        if k:
            pairs[k - 1] = merges.get((ids[k - 1], ids[k]), none)
        if k < len(pairs):
            pairs[k] = merges.get((ids[k], ids[k + 1]), none)
    return ids


def _merge_long(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*merges[p], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
    heap = [(rank, k, new, a, b) for rank, new, k, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, k, new, a, b = heapq.heappop(heap)
        nxt = after[k]
        if ids[k] != a or nxt < 0 or ids[nxt] != b:
            continue
        ids[k], ids[nxt] = new, -1
        after[k] = after[nxt]
        if after[k] >= 0:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] >= 0:
                pair = ids[left], ids[after[left]]
                if pair in merges:
                    heapq.heappush(heap, (merges[pair][0], left, merges[pair][1], *pair))
    return [i for i in ids if i >= 0]


class Merger:
    """Merges many pieces at a time, a row each; longer ones by themselves."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pairs, self.made = vocabulary.pairs, vocabulary.made
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        # The merge of any two bytes.
        self.bytes_made = self._lookup(self.byte_ids[:, None], self.byte_ids[None, :])
        self.merges: dict[tuple[int, int], tuple[int, int]] | None = None

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out: list[list[int]] = [[] for _ in pieces]
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(some):
                made = self._rows(b"".join([pieces[i] for i in some]), sizes[some], width)
                for i, row, n in zip(some.tolist(), made.tolist(), (made >= 0).sum(1).tolist(), strict=True):
                    out[i] = row[:n]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            if self.merges is None:
                self.merges = {divmod(k, 1 << _HALF): divmod(v, 1 << _HALF) for k, v in zip(self.pairs.tolist(), self.made.tolist(), strict=True)}
            out[i] = merge(self.byte_ids[np.frombuffer(pieces[i], np.uint8)].tolist(), self.merges)
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and id of each pair, or ``_NONE``; an id of -1 has no merge."""
        if not len(self.pairs):
            return np.full(np.broadcast(left, right).shape, _NONE)
        key = (left << _HALF) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], _NONE)

    def _rows(self, data: bytes, sizes: np.ndarray, width: int) -> np.ndarray:
        """The ids of pieces of at most ``width`` bytes, a row each, filled with -1; in each step every row merges its first pair of the lowest rank."""
        held = np.arange(width) < sizes[:, None]
        raw = np.zeros(held.shape, np.uint8)
        raw[held] = np.frombuffer(data, np.uint8)
        ids = np.where(held, self.byte_ids[raw], -1)
        value = np.full(held.shape, _NONE)
        value[:, :-1] = np.where(held[:, 1:], self.bytes_made[raw[:, :-1], raw[:, 1:]], _NONE)
        out, rows, places = np.empty_like(ids), np.arange(len(ids)), np.arange(width - 1)
        while len(rows):
            k = value.argmin(1)
            best = value[np.arange(len(rows)), k]
            go = best < _NONE
            if not go.all():
                out[rows[~go]] = ids[~go]
                rows, ids, value, k, best = rows[go], ids[go], value[go], k[go], best[go]
            line, new = np.arange(len(rows)), best & _LOW
            # What stands behind the pair moves one place to the left.
            source = places + (places > k[:, None])
            for table, rest in ((ids, -1), (value, _NONE)):
                table[:, :-1] = np.take_along_axis(table, source, 1)
                table[:, -1] = rest
            ids[line, k] = new
            value[line, k] = self._lookup(new, ids[line, k + 1])
            line = np.flatnonzero(k)
            value[line, k[line] - 1] = self._lookup(ids[line, k[line] - 1], new[line])
        return out


class Encoder:
    """Encodes texts of one task: the lexicon first, exact merges for words it lacks, and a memory of both."""

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes) -> None:
        self.vocabulary = vocabulary
        self.lexicon = Lexicon(lexicon)
        self.pieces = regex.compile(PIECES)
        self.ascii = re.compile(ASCII_PIECES)
        self.odd = regex.compile(f"[{vocabulary.odd}]") if vocabulary.odd else None
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.merger = Merger(vocabulary)
        self.id_texts = {i: str(i) for i in vocabulary.id_bytes}
        # Ids of a piece, joined by commas, and the bytes they stand for.
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text and its special tokens, in order."""
        if self.special is None or not self.special.search(text):
            return self._cut_plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._cut_plain(text[at:m.start()]), m[0]]
            at = m.end()
        return [*out, *self._cut_plain(text[at:])]

    def _cut_plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        if self.odd is None or not self.odd.search(text):
            return self.pieces.findall(text)
        # A character that is neither letter nor number to the library is stood in for by a sign.
        return [text[m.start():m.end()] for m in self.pieces.finditer(self.odd.sub("§", text))]

    def learn(self, texts: list[list[str]]) -> None:
        """Remember all pieces of some texts."""
        if len(self.ids) > MEMORY:
            self.ids.clear()
            self.bytes.clear()
        new = list(set().union(*texts).difference(self.ids))
        coded = [p.encode() for p in new]
        special, id_bytes, id_texts = self.vocabulary.special, self.vocabulary.id_bytes, self.id_texts
        known = [[special[p]] if p in special else x if x is None else x.tolist() for p, x in zip(new, self.lexicon.lookup(coded), strict=True)]
        merged = iter(self.merger([c for c, x in zip(coded, known, strict=True) if x is None]))
        for piece, ids in zip(new, known, strict=True):
            if ids is None:
                ids = next(merged)
            self.ids[piece] = ",".join([id_texts[i] for i in ids])
            self.bytes[piece] = b"".join([id_bytes[i] for i in ids])
