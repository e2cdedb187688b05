"""Language-model scores by online logistic context mixing, beside a unigram base score.

The corpus is read twice. The first reading gathers, over all training texts, how often each
token occurs and which bytes followed each hashed context; both are summed in the tasks and
then by shuffle. The contexts make the mixing model, whose size is fixed (``context_mixing``). The
second reading scores every text with it.

Token counts grow with the corpus and stay in the cluster: only those of the ``COMMON`` most
frequent tokens are broadcast, and tokens that are not among them are looked up by a join.

Defined cases: null and empty texts are one end token; if nothing was learned every count is 0 and
the model gives each byte its prior; a null id is not held out; repeated rows are each
returned; other columns travel in ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import context_mixing as cm
from fleetscope.llm.common import WHITE, carried, chunks, frequent, hash_spans, held_out, map_texts, signed, small_batches, store, table, text_buffers, word_spans

# Tokens whose counts are broadcast (2 MB), a bound on that and on nothing else.
COMMON = 1 << 17
# Distinct tokens a task holds before it hands their counts to the shuffle.
PENDING = 1 << 20
_TOKENS = -1


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = word_spans(data, offsets, WHITE)
    return signed(hash_spans(data, starts, ends, lower=True)), counts


def gather(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts: token counts, and per order the counts of (context, byte) cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = cm.empty_counts()
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": pa.array(key), "n": pa.array(n)})

        def tokens() -> pa.RecordBatch:
            key, place = np.unique(np.concatenate([k for k, _ in pending]), return_inverse=True)
            return rows(_TOKENS, key, np.bincount(place, np.concatenate([n for _, n in pending])).astype(np.int64))

        for batch in batches:
            for part in chunks(batch, 0):
                data, offsets = text_buffers(part.column(0))
                pending.append(np.unique(_hashes(data, offsets)[0], return_counts=True))
                size += len(pending[-1][0])
                symbols, place, _ = cm.sequence(data, offsets)
                cm.count(symbols, place, cells)
                if size > PENDING:
                    yield tokens()
                    pending, size = [], 0
        if pending:
            yield tokens()
        for order, cell in enumerate(cells):
            some = np.flatnonzero(cell)
            yield rows(order, some, cell[some].astype(np.int64))

    made = texts.select("text").mapInArrow(run, "kind int, key bigint, n bigint")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def mixing_model(gathered: DataFrame) -> cm.Model:
    """The mixing model; what comes to the driver is bounded by the tables of ``context_mixing``."""
    def counts(order: int) -> np.ndarray:
        out = np.zeros(1 << (cm.ORDERS[order][1] + 8), np.float32)
        rows = gathered.where(F.col("kind") == order).select("key", "n").toArrow()
        out[rows["key"].to_numpy()] = rows["n"].to_numpy()
        return out

    code = cm.code_of(counts(0).reshape(-1, 256).sum(0))
    last = counts(len(cm.ORDERS) - 1)
    gate, odds = cm.gates(last), cm.log_odds(last, code)
    del last
    return cm.Model(*code, [*[cm.log_odds(counts(k), code) for k in range(len(cm.ORDERS) - 1)], odds], gate)


def scores(docs: DataFrame, training: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), token counts, ``base_score``, ``score`` and ``bits_per_byte``; ``training`` has ``text``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    gathered = store(gather(training), "gathered")
    tokens = gathered.where(F.col("kind") == _TOKENS).select("key", "n")
    texts = training.count()
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + texts, distinct + (texts > 0)
    top = frequent(tokens, COMMON).toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((top["key"].to_numpy(), top["n"].to_numpy(), mixing_model(gathered)))

    def run(data: np.ndarray, offsets: np.ndarray, learned: tuple) -> dict:
        keys, n, model = learned
        hashes, counts = _hashes(data, offsets)
        known, base, rare, times = [], [], [], []
        first = 0
        for size in counts:
            key, number = np.unique(hashes[first:first + size], return_counts=True)
            first += size
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(key), int)
            common = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            base.append(float((number[common] * np.log10(n[at[common]] + 1.0)).sum()))
            known.append(int(number[common].sum()))
            rare.append(key[~common])
            times.append(number[~common].astype(np.int32))
        symbols, place, sizes = cm.sequence(data, offsets)
        return {"n_words": pa.array(counts.astype(np.int64)), "common": pa.array(known, pa.int64()), "log_common": pa.array(base, pa.float64()),
                "rare": pa.array(rare, pa.list_(pa.int64())), "times": pa.array(times, pa.list_(pa.int32())),
                "nats": pa.array(cm.score(symbols, place, sizes, model)), "n_bytes": pa.array(sizes.astype(np.int64))}

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").alias("text"))
    read = store(map_texts(rows, "text", ["doc"], run, "n_words bigint, common bigint, log_common double, rare array<bigint>, times array<int>,"
                           " nats double, n_bytes bigint", lambda: shared.value).withColumn("row", F.monotonically_increasing_id()), "scored")
    looked_up = (read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), "x.times")
                 .join(tokens, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_more")))
    number, floor = F.col("n_words") + 1, float(np.log10(total + distinct + 1))
    known = F.col("common") + F.coalesce("more", F.lit(0)) + (1 if texts else 0)
    logs = F.col("log_common") + F.coalesce("log_more", F.lit(0.0)) + float(np.log10(texts + 1))
    return (read.drop("rare", "times").join(looked_up, "row", "left")
            .select("doc", number.alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
                    (logs - number * floor).alias("base_score"), (F.col("nats") / float(np.log(10))).alias("score"),
                    (-F.col("nats") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte")))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    training = docs.where(~held_out("doc_id", 7, 2)).select("text")
    return scores(docs, training, carry=["doc_id"]).select("doc.doc_id", held_out("doc.doc_id", 7, 2), "n_tokens", "n_known", "train_tokens",
                                                           "base_score", "score", "bits_per_byte")
