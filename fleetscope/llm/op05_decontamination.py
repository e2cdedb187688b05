"""Benchmark decontamination: an FM-index over each shard of the training texts.

Words are runs of letters, digits and non-ASCII characters with A-Z folded. A shard is about a
million words that a task has read; its index is searched backwards for every phrase of ten
consecutive benchmark words (shorter items are one phrase), occurrences are located by
sampled positions, and the words they cover are merged into spans to remove.

The benchmark is the query set. It goes to the tasks in blocks of bounded size, one after the
other, so neither its size nor the number of its phrases bounds the corpus. Texts longer than a
shard are indexed in pieces that overlap by a phrase.

Defined cases: null or empty texts have no words and are clean; an item without words has no
phrase; items that share an id are one item, and an item with a null id marks words but is in no
list; repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.common import NOT_ALNUM, U64, carried, chunks, hash_spans, small_batches, table, text_buffers, word_spans
from fleetscope.llm.fm_index import FmIndex

PHRASE = 10
# Words in a shard, which bounds a task's memory, and benchmark words in a broadcast block (8 MB).
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20

RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, counts = word_spans(data, offsets, NOT_ALNUM)
    return hash_spans(data, starts, ends, lower=True), starts, ends, counts


def query_blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The items' word hashes in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    for name, value in rows.toLocalIterator():
        words = _words(*text_buffers(pa.array([value or ""])))[0]
        # A longer item goes into several blocks that overlap by a phrase.
        for at in range(0, max(1, len(words) - PHRASE + 1), BLOCK_WORDS):
            part = words[at:at + BLOCK_WORDS + PHRASE - 1]
            if len(part):
                block.append((name, part))
                size += len(part)
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def phrases(block: list[tuple[str | None, np.ndarray]]) -> dict[int, tuple[np.ndarray, list[list[str | None]]]]:
    """By length: the distinct phrases of a block and the items each belongs to."""
    rows: dict[int, dict[bytes, list[str | None]]] = {}
    for name, words in block:
        k = min(PHRASE, len(words))
        for at in range(len(words) - k + 1):
            rows.setdefault(k, {}).setdefault(words[at:at + k].tobytes(), []).append(name)
    return {k: (np.frombuffer(b"".join(v), U64).reshape(-1, k), list(v.values())) for k, v in rows.items()}


class _Shard:
    """Words of the rows a task has read and not yet searched."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.pieces: list[tuple[int, int, np.ndarray]] = []  # row, first word, hashes
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # character starts and ends of the words
        self.size = 0

    def add(self, part: pa.RecordBatch, column: int) -> None:
        data, offsets = text_buffers(part.column(column))
        hashes, starts, ends, counts = _words(data, offsets)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = 0
        for i, n in enumerate(counts):
            base = chars[offsets[i]]
            row = len(self.rows)
            self.rows.append(((chars[starts[at:at + n]] - base).astype(np.int32), (chars[ends[at:at + n]] - base).astype(np.int32)))
            for first in range(0, max(1, n - PHRASE + 1), SHARD_WORDS):
                self.pieces.append((row, first, hashes[at + first:at + min(n, first + SHARD_WORDS + PHRASE - 1)]))
            at += n
        self.parts.append(part)
        self.size += int(counts.sum())

    def found(self, blocks: list) -> tuple[list[np.ndarray], list[set]]:
        """Which words of each row are hit, and by which items."""
        hit = [np.zeros(len(s), bool) for s, _ in self.rows]
        items: list[set] = [set() for _ in self.rows]
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for piece in [*self.pieces, None]:
            if group and (piece is None or size + len(piece[2]) > SHARD_WORDS + PHRASE):
                self._search(group, blocks, hit, items)
                group, size = [], 0
            if piece is not None and len(piece[2]):
                group.append(piece)
                size += len(piece[2])
        return hit, items

    @staticmethod
    def _search(group: list, blocks: list, hit: list[np.ndarray], items: list[set]) -> None:
        vocabulary, code = np.unique(np.concatenate([p[2] for p in group]), return_inverse=True)
        # Each piece ends with a symbol of its own, below the words.
        ends = np.cumsum([len(p[2]) for p in group])
        symbols = np.insert(code + len(group) + 1, ends, np.arange(1, len(group) + 1)[::-1])
        begin = np.concatenate([[0], ends[:-1]]) + np.arange(len(group))
        index = FmIndex(symbols)
        for block in blocks:
            for k, (rows, names) in block.value.items():
                at = np.minimum(np.searchsorted(vocabulary, rows), len(vocabulary) - 1)
                known = np.flatnonzero((vocabulary[at] == rows).all(1))
                which, lo, hi = index.search(at[known] + len(group) + 1)
                if not len(which):
                    continue
                number = hi - lo
                row = np.repeat(lo - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
                position = index.locate(row)
                phrase = np.repeat(known[which], number)
                piece = np.searchsorted(begin, position, "right") - 1
                for i in np.unique(piece):
                    mine = piece == i
                    doc, first, _ = group[i]
                    for j in range(k):
                        hit[doc][position[mine] - begin[i] + first + j] = True
                    for p in np.unique(phrase[mine]):
                        items[doc].update(names[p])
            vars(block).pop("_value", None)  # one block in memory at a time

    def results(self, blocks: list) -> Iterator[pa.RecordBatch]:
        hit, items = self.found(blocks)
        at = 0
        for part in self.parts:
            rows = range(at, at + part.num_rows)
            at += part.num_rows
            spans = [self._spans(hit[r], *self.rows[r]) for r in rows]
            yield pa.RecordBatch.from_pydict({
                "doc": part.column(0), "n_words": pa.array([len(hit[r]) for r in rows], pa.int64()),
                "n_hit": pa.array([int(hit[r].sum()) for r in rows], pa.int64()),
                "items": pa.array([sorted(x for x in items[r] if x is not None) for r in rows], pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    @staticmethod
    def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
        """Characters from the first to the last word of each run of hit words."""
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        return [{"start": int(starts[a]), "end": int(ends[b - 1])}
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), ``n_words``, ``n_hit``, ``items`` and the character ``spans`` to remove."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(phrases(b)) for b in query_blocks(benchmark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for part in chunks(batch, 1):
                shard.add(part, 1)
                if shard.size >= SHARD_WORDS:
                    yield from shard.results(blocks)
                    shard = _Shard()
        yield from shard.results(blocks)

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc"], *StructType.fromDDL(RESULT).fields]))


def without_spans(text: str, spans: str) -> F.Column:
    """``text`` without the characters of ``spans``, which are ordered and apart."""
    n = F.size(spans)
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col(text), F.when(i == 0, 1).otherwise(F.get(F.col(spans), i - 1)["end"] + 1),
        F.when(i == n, F.length(text)).otherwise(F.get(F.col(spans), i)["start"]) - F.when(i == 0, 0).otherwise(F.get(F.col(spans), i - 1)["end"])))
    return F.when(n == 0, F.col(text)).otherwise(F.array_join(cut, ""))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
place AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM d, (SELECT DISTINCT k FROM phrase), unnest(range(1, greatest(1, len(w) - k + 2))) AS t(i)),
found AS (SELECT doc_id, i, k, item_id FROM place JOIN phrase USING (k, p)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
