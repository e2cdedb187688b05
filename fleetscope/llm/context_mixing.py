"""Bit predictors of hashed contexts, mixed by gated weights that are refined while a text is read.

Bytes are coded by a binary tree made from their frequencies, so that a byte is a few decisions.
For each order, the bytes that followed each hashed context in training give the log odds of every
decision of the tree. A text is read in blocks; in each block the odds of all orders are summed
with the text's own weights, and after the block the weights take a step towards what would have
predicted it better. Which weights apply is gated by the depth in the tree and by how often the
word so far was seen in training. A weight never depends on text to come.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from fleetscope.llm.common import LOWER, WHITE

# Order (bytes of context; WORD: all bytes of the word so far) and bits of the context's hash.
WORD = 0
ORDERS = ((1, 8), (3, 14), (4, 16), (WORD, 17))
# The end of a text, a byte no UTF-8 text has.
END = 0xFF
# Count given to either side of a decision beforehand.
PRIOR = 0.4
# Symbols in the first block; each further block is twice as long.
FIRST_BLOCK = 128
# How often a word so far must have been seen in training for the next gate.
GATES = (1, 8, 64)
# Weight of each order before the first block, by gate, and the size of a step.
START = ((0.1, 0.3, 0.8, 0.0), (0.1, 0.33, 0.63, 0.31), (0.2, 0.42, 0.55, 0.54), (0.02, 0.18, 0.48, 0.51))
RATE = 0.5
_HASH = np.uint32(0x9E3779B1)
_STEP = 0x01000193
_BACK = pow(_STEP, -1, 1 << 32)
# Powers of the two, as far as they were needed.
_POWERS: list[np.ndarray] = []


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as words with A-Z folded, one space between and an end after each text.

    Returns the symbols, the place of each in its text, and the symbols of each text.
    """
    blank = WHITE[data]
    keep = ~blank
    # A blank stays if a word came before it and the next byte begins another.
    keep[:-1] |= blank[:-1] & ~blank[1:]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    keep[edge[edge > 0] - 1] &= ~blank[edge[edge > 0] - 1]
    first = np.concatenate([[0], np.cumsum(~blank)])
    begun = first[:-1] > np.repeat(first[offsets[:-1]], np.diff(offsets))
    keep &= begun | ~blank
    symbols = LOWER[data].copy()
    symbols[blank] = 0x20
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    symbols = np.insert(symbols[keep], at[1:], END)
    sizes = np.diff(at) + 1
    begin = np.cumsum(sizes) - sizes
    return symbols, np.arange(len(symbols)) - np.repeat(begin, sizes), sizes


def contexts(symbols: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The hashed context of each symbol, for each order; nothing before its text is seen."""
    out, code = [], np.zeros(len(symbols), np.uint32)
    seen = 0
    for order, bits in ORDERS:
        if order == WORD:
            out.append(_word_so_far(symbols, place) >> np.uint32(32 - bits))
            continue
        for k in range(seen + 1, order + 1):
            previous = np.zeros(len(symbols), np.uint32)
            np.multiply(symbols[:-k], place[k:] >= k, out=previous[k:], dtype=np.uint32, casting="unsafe")
            code = code * np.uint32(257) + previous + np.uint32(1) if k > 1 else previous
        seen = order
        out.append(code if order == 1 else (code * _HASH) >> np.uint32(32 - bits))
    return out


def _word_so_far(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the bytes from the last white space (itself left out) to each symbol (itself left out)."""
    n = len(symbols)
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint32(1), np.full(max(n, 1 << 16), x, np.uint32)), dtype=np.uint32) for x in (_STEP, _BACK)]
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((symbols.astype(np.uint32) + np.uint32(1)) * _POWERS[0][:n], dtype=np.uint32, out=sums[1:])
    first = place == 0
    first[1:] |= WHITE.take(symbols[:-1])
    # Where the word of each symbol begins.
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    code = (sums[:-1] - np.repeat(sums.take(starts), sizes)) * np.repeat(_POWERS[1].take(starts), sizes)
    code ^= code >> np.uint32(15)
    return code * _HASH


def count(symbols: np.ndarray, place: np.ndarray, into: list[np.ndarray]) -> None:
    """Add how often each symbol followed each context."""
    for context, total in zip(contexts(symbols, place), into, strict=True):
        cells = (context << np.uint32(8)) + symbols
        if len(total) <= 1 << 16:
            total += np.bincount(cells, minlength=len(total)).astype(total.dtype)
        else:
            cell, number = np.unique(cells, return_counts=True)
            total[cell] += number


def empty_counts() -> list[np.ndarray]:
    return [np.zeros(1 << (bits + 8), np.int32) for _, bits in ORDERS]


@dataclass(frozen=True)
class Model:
    """Codes of the bytes and log odds of the decisions."""

    length: np.ndarray  # decisions of each byte
    node: np.ndarray  # [depth, byte]: the decision taken there
    sign: np.ndarray  # [depth, byte]: which way, 1 or -1
    odds: list[np.ndarray]  # by order: [context * 256 + decision]
    gate: np.ndarray  # by hash of the word so far: how well it is known


def tree_codes(frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary tree of all 256 bytes with short paths for frequent ones."""
    heap = [(int(n), b, (b,)) for b, n in enumerate(frequency)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (na, a, left), (nb, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for side, members in ((-1, left), (1, right)):
            for b in members:
                paths[b].append((node, side))
        heapq.heappush(heap, (na + nb, a, left + right))
    length = np.array([len(p) for p in paths])
    node, sign = np.zeros((length.max(), 256), np.int64), np.ones((length.max(), 256), np.float32)
    for b, path in enumerate(paths):
        for d, (n, s) in enumerate(reversed(path)):
            node[d, b], sign[d, b] = n, s
    return length, node, sign


def code_of(frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree for bytes of these frequencies; rare bytes get a share that bounds its depth."""
    return tree_codes(frequency + 1 + frequency.sum() // 100_000)


def log_odds(counts: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log odds of every decision in every context of one order."""
    length, node, sign = code
    down = np.zeros((2, 256, 256), np.float32)
    for b in range(256):
        for d in range(length[b]):
            down[int(sign[d, b] > 0), b, node[d, b]] = 1
    table = counts.reshape(-1, 256)
    out = np.empty(table.shape, np.float16)
    for at in range(0, len(table), 4096):
        part = table[at:at + 4096].astype(np.float32)
        out[at:at + 4096] = np.log((part @ down[1] + PRIOR) / (part @ down[0] + PRIOR))
    return out.reshape(-1)


def gates(counts: np.ndarray) -> np.ndarray:
    return np.digitize(counts.reshape(-1, 256).sum(1), GATES).astype(np.uint8)


def score(symbols: np.ndarray, place: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Natural logarithm of the probability of each text, its end included."""
    total = np.zeros(len(sizes))
    codes = contexts(symbols, place)
    # Blocks double: block 0 has the first symbols, block k those from 2**(k-1) first blocks on.
    block = np.zeros(len(symbols), np.int64)
    late = place >= FIRST_BLOCK
    block[late] = np.log2(place[late] // FIRST_BLOCK).astype(np.int64) + 1
    number = len(GATES) + 1
    # A row of weights belongs to a text and a gate.
    owner = np.repeat(np.arange(len(sizes)), sizes) * number + model.gate[codes[-1]]
    by = np.argsort(block * (len(sizes) * number) + owner, kind="stable")
    # Cells of a table are fewer than 2**31.
    owner, symbols, codes = owner[by], symbols[by].astype(np.intp), [(c[by] << np.uint32(8)).astype(np.int32) for c in codes]
    edges = np.searchsorted(block[by], np.arange(block.max(initial=0) + 2))
    depth, nodes = len(model.node), model.node.astype(np.int32)
    weights = np.repeat(np.tile(np.array(START, np.float32), (len(sizes), 1))[:, None, :], depth, 1)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s, longest = symbols[a:b], model.length[symbols[a:b]]
        who, at = owner[a:b], [c[a:b] for c in codes]
        for d in range(depth):
            if d:
                more = np.flatnonzero(longest > d)
                if not len(more):
                    break
                s, longest, who, at = s.take(more), longest.take(more), who.take(more), [c.take(more) for c in at]
            head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            rows, run = who[head], np.diff(np.append(head, len(who)))
            node, sign = nodes[d].take(s), model.sign[d].take(s)
            margins = [table.take(c + node) * sign for table, c in zip(model.odds, at, strict=True)]
            z = np.zeros(len(s), np.float32)
            for k, m in enumerate(margins):
                z += np.repeat(weights[rows, d, k], run) * m
            e = np.exp(-np.clip(z, -30, 30))
            whole = 1 + e
            np.subtract.at(total, rows // number, np.add.reduceat(np.log(whole), head, dtype=np.float64))
            miss = e / whole
            step = RATE / (run + 30)
            for k, m in enumerate(margins):
                weights[rows, d, k] += step * np.add.reduceat(miss * m, head)
    return total
