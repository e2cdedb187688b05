"""Spelling variants: pairs of words one edit apart by composition of finite-state machines.

Words are runs of letters with A-Z folded, counted over all texts. The vocabulary is what is long and
frequent enough. Its acceptor is partitioned by initial states: a shorter word of length l and an
equally long or one letter longer word that are one edit apart share either the first half of the shorter one or the
rest of it, so a partition is the words (of lengths l and l + 1) with one half in common, and its
initial state the one reached by that half. In each partition the minimised acceptor of what remains is composed with the
one-edit transducer and the acceptor again, and the accepted pairs are enumerated. A partition with too many words for
a task is cut again: half of what it left open is fixed too. When one letter is left open, a partition
has no more words than pairs of letters, so every partition ends up small, and no pair is left out.

Each word then points to its most frequent near word, if that is frequent enough, and the
pointers are doubled until they end; frequencies grow along them, so they have no cycle.

Defined cases: null and empty texts have no words; a null id is an empty text in the simulated
misspelling; repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import chunks, small_batches, store, table
from fleetscope.llm.word_acceptor import one_edit_pairs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
LEAST_LETTERS = 6
LEAST_COUNT = 5
# A form is so many times as frequent as its variant.
FORM_RATIO = 5
# One in so many (document, word) has a letter deleted.
SLIP = 199
# Distinct words a task counts before it hands them on, and words of a partition.
COUNTED_TOGETHER = 200_000
PARTITION_WORDS = 20_000
# Characters that are taken apart at a time.
PIECE = 1 << 20


def slipped(doc_id: str) -> Callable[[str], str]:
    """Deletes a letter of some words of a document, chosen by crc32 of ``<doc_id>:<word>``."""
    begin = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), begin)
        if h % SLIP:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1:]

    return change


def unchanged(doc_id: str) -> Callable[[str], str]:
    return lambda word: word


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, in lists of bounded size."""
    if len(text) <= PIECE:
        yield RUN.findall(text)
        return
    held: list[str] = []
    for found in RUN.finditer(text):
        held.append(found.group())
        if len(held) == PIECE:
            yield held
            held = []
    yield held


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                change: Callable[[str], Callable[[str], str]] = unchanged) -> DataFrame:
    """(word, n) over all texts, after ``change(doc_id)`` of each word."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in chunks(batch, 1):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not value:
                        continue
                    altered = change(name or "")
                    here: Counter = Counter()
                    for runs in _runs(value.encode().translate(FOLD).decode()):
                        here.update(runs)
                    for word, n in here.items():
                        total[altered(word)] += n
                    if len(total) >= COUNTED_TOGETHER:
                        yield _counted(total)
                        total.clear()
        yield _counted(total)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _partitioned(words: DataFrame, low: Column, high: Column) -> DataFrame:
    """Words with the open part of the partition they are in and its key: what stands before and after the open part."""
    tail = F.col("length") - F.col("high")
    opened = (words.withColumn("low", low).withColumn("high", high)
              .withColumn("middle", F.expr("substring(word, low + 1, char_length(word) - low - (length - high))"))
              .withColumn("tail", F.when(tail > 0, F.expr("right(word, length - high)")).otherwise("")))
    return opened.select("word", "n", "length", "low", "high", "middle",
                         F.concat_ws(":", "length", "low", "high", F.expr("left(word, low)"), "tail").alias("key"))


def _pairs_of(key: tuple, rows: list[tuple[str, int, str]]) -> Iterator[tuple[str, int, str, int]]:
    _, length, low, high = key
    shorter = {m: (w, n) for w, n, m in rows if len(w) == length}
    longer = {m: (w, n) for w, n, m in rows if len(w) > length}
    if not shorter or len(rows) < 2:
        return
    for a, b in one_edit_pairs(list(shorter), list(longer), high - low, high == length):
        u, v = shorter[a], shorter.get(b) if len(a) == len(b) else longer[b]
        yield *u, *v


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each partition; its rows come one after the other."""
    names = ("word", "n", "near", "near_n")
    found: list[tuple] = []
    key, rows = None, []

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in found], pa.string() if k % 2 == 0 else pa.int64()) for k, n in enumerate(names)})

    for batch in batches:
        for k, length, low, high, word, n, middle in zip(*(batch.column(c).to_pylist() for c in ("key", "length", "low", "high", "word", "n", "middle")), strict=True):
            if key is None or k != key[0]:
                if key is not None:
                    found.extend(_pairs_of(key, rows))
                key, rows = (k, length, low, high), []
                if len(found) >= COUNTED_TOGETHER:
                    yield batch_of(found)
                    found = []
            rows.append((word, n, middle))
    if key is not None:
        found.extend(_pairs_of(key, rows))
    yield batch_of(found)


def near_words(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, n, near, near_n): every pair of ``words`` (word, n) one edit apart, once."""
    size = F.char_length("word")
    classed = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"))
    half = F.floor(F.col("length") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("length").alias("high")))
    cut = classed.select("*", F.explode(halves).alias("part"))
    level = _partitioned(cut, F.col("part.low"), F.col("part.high"))
    whole = None
    while True:
        level = store(level, "spelling-partitions")
        # Few partitions are that large: their number is the vocabulary's over the limit.
        large = level.groupBy("key").agg(F.count("*").alias("size")).where((F.col("size") > most) & (F.element_at(F.split("key", ":"), 3).cast("int") - F.element_at(F.split("key", ":"), 2).cast("int") > 1)).select("key")
        large = store(large, "spelling-large")
        small = level.join(large, "key", "left_anti")
        whole = small if whole is None else whole.unionByName(small)
        if large.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        again = level.join(large, "key", "left_semi").select(
            "word", "n", "length", F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))).alias("part"))
        level = _partitioned(again, F.col("part.low"), F.col("part.high"))
    placed = whole.select("key", "length", "low", "high", "word", "n", "middle").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(_enumerated, "word string, n bigint, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers doubled until none moves."""
    at = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        up = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = store(at.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                   "spelling-roots")
    return at.select("word", "root")


def spelling_variants(counts: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO,
                      most: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n) that are long and frequent enough."""
    words = store(counts.where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count)), "spelling-words")
    pairs = near_words(words, most)
    both = pairs.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("b"))
    is_form = -F.col("b.down") >= ratio * F.col("n")
    near = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"),
        F.when(is_form, -F.col("b.down")).alias("form_n")), "spelling-near")
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), change=slipped))
