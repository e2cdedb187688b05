"""BPE encoding and decoding with a transducer of frequent words.

Spark counts the words of the whole corpus; the most frequent ones are encoded once and compiled
into a minimal acyclic transducer, which tasks map into memory. A task looks up the distinct
pieces of its texts there, all at once, and merges the ones it lacks exactly. The lexicon only
saves work: the ids do not depend on what it holds.

Defined cases: null and empty texts have no tokens; the texts of special tokens are those tokens,
as in the library; repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm import lexicon
from fleetscope.llm.byte_bpe import Encoder, Merger, Vocabulary, load
from fleetscope.llm.common import carried, chunks, frequent, small_batches, store, table

# Words in the lexicon: a bound on its size (about 2 MB), not on what is encoded.
LEXICON_WORDS = 1 << 15
# Distinct words a task counts before it hands them to the shuffle.
COUNTED = 200_000


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent letter words after a space, over all texts, at most ``limit``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = Counter()
            for w, n in counter.items():
                w = w.rstrip(".,;:!?")
                if w.isalpha() and len(w) < 40:
                    words[w] += n
            counter.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for value in batch.column(0):
                counter.update((value.as_py() or "").split(" "))
                if len(counter) > COUNTED:
                    yield flush()
        yield flush()

    words = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    counted = store(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    return [r.word for r in frequent(counted, limit).collect()]


def compile_lexicon(words: list[str], vocabulary: Vocabulary) -> bytes:
    """The transducer of the words with a leading space."""
    coded = [(" " + w).encode() for w in words]
    return lexicon.build(dict(zip(coded, Merger(vocabulary)(coded), strict=True)))


def _digests(encoder: Encoder, texts: list[list[str]]) -> dict:
    ids = [",".join(map(encoder.ids.__getitem__, pieces)) for pieces in texts]
    decoded = [b"".join(map(encoder.bytes.__getitem__, pieces)).decode("utf-8", "replace") for pieces in texts]
    return {"n_tokens": pa.array([s.count(",") + 1 if s else 0 for s in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded])}


def _ids(encoder: Encoder, texts: list[list[str]]) -> dict:
    rows = [np.fromstring(",".join(map(encoder.ids.__getitem__, pieces)), np.int32, sep=",") for pieces in texts]
    return {"n_tokens": pa.array([len(r) for r in rows], pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))}


_SCHEMAS = {_digests: "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _ids: "n_tokens bigint, ids array<int>"}


def _encoded(docs: DataFrame, path: str, text: str, carry: list[str] | None, result) -> DataFrame:
    small_batches(docs.sparkSession)
    vocabulary = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, compile_lexicon(frequent_words(docs, text), vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for part in chunks(batch, 1):
                texts = [encoder.cut(t or "") for t in part.column(1).to_pylist()]
                encoder.learn(texts)
                yield pa.RecordBatch.from_pydict({"doc": part.column(0), **result(encoder, texts)})

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc"], *StructType.fromDDL(_SCHEMAS[result]).fields]))


def encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), ``n_tokens`` and the token ``ids`` of each text."""
    return _encoded(docs, path, text, carry, _ids)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with the ``text`` of their ids in ``decoded``; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path).id_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [b"".join([known[i] for i in row or []]).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc": batch.column(0), "decoded": pa.array(texts, pa.string())})

    chosen = rows.select(carried(rows, None), F.col(f"`{ids}`").alias("ids"))
    return chosen.mapInArrow(run, StructType([chosen.schema["doc"], *StructType.fromDDL("decoded string").fields]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of all documents."""
    import public_tokenizers

    rows = _encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "text", ["doc_id"], _digests)
    return rows.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
