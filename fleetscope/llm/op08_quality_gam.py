"""Quality classifier: a generalised additive model over measures of the text (``boosted_gam``).

Measures are taken from the whole text in one pass over its bytes. The model is fitted on at most
``SAMPLE`` labelled texts, those whose ids have the least hash, and is a set of lookup tables;
a score is a sum of table entries.

Defined cases: null and empty texts have all measures zero and are scored like any other; labels
that are null or without a document teach nothing; without labels every score is one half;
repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import boosted_gam
from fleetscope.llm.common import WHITE, carried, hash_spans, held_out, map_texts, table, windows, word_spans

# Labelled texts the model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3

FEATURES = ("words", "characters", "lines", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "repeated_runs",
            "repeated_lines", "line_words", "upper", "upper_words", "digits", "symbols", "stops", "commas", "exclamations", "marks", "wide",
            "blank", "symbol_words", "top_word", "end_stops")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {"upper": _class(bytes(range(0x41, 0x5B))), "digits": _class(b"0123456789"), "symbols": _class(b"#*$%&|<>{}[]\\^~=_@+/"),
            "stops": _class(b"."), "commas": _class(b","), "exclamations": _class(b"!?"), "marks": _class(b"\"'():;-"), "blank": WHITE}
_WORD_SYMBOL = _CLASSES["symbols"] | _CLASSES["exclamations"]


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each text, one row a text."""
    starts, ends, counts = word_spans(data, offsets, WHITE)
    hashes = hash_spans(data, starts, ends, lower=True)
    first = np.concatenate([[0], np.cumsum(counts)])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def summed(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    chars = np.diff(points[offsets])
    per_char = {k: summed(c[data], offsets) / np.maximum(chars, 1) for k, c in _CLASSES.items()}
    wide = summed(data >= 0xC0, offsets) / np.maximum(chars, 1)
    length = points[ends] - points[starts]
    n = np.maximum(counts, 1)
    mean = summed(length, first) / n
    spread = np.sqrt(np.maximum(summed(length**2, first) / n - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    has_upper = upper[ends] - upper[starts] >= 2
    symbol = np.concatenate([[0], np.cumsum(_WORD_SYMBOL[data])])
    with_symbol = symbol[ends] > symbol[starts]
    newline = np.flatnonzero(data == 0x0A)
    out = np.zeros((len(counts), len(FEATURES)))
    for i in range(len(counts)):
        a, b, lo, hi = first[i], first[i + 1], offsets[i], offsets[i + 1]
        if a == b:
            continue
        words = hashes[a:b]
        _, number = np.unique(words, return_counts=True)
        runs = windows(words, 3)
        breaks = newline[np.searchsorted(newline, lo):np.searchsorted(newline, hi)]
        bounds = np.concatenate([[lo], breaks + 1, [hi + 1]])
        lines = hash_spans(data, bounds[:-1], bounds[1:] - 1)[np.diff(np.searchsorted(starts[a:b], bounds)) > 0]
        ended = data[bounds[1:][bounds[1:] - 2 >= lo] - 2] == 0x2E
        out[i] = (np.log1p(b - a), np.log1p(chars[i]), np.log1p(len(lines)), mean[i], spread[i], 0, 0, len(number) / (b - a),
                  1 - len(np.unique(runs)) / max(len(runs), 1) if len(runs) else 0, 1 - len(np.unique(lines)) / max(len(lines), 1), (b - a) / max(len(lines), 1),
                  *[0] * 11, number.max() / (b - a), ended.mean() if len(ended) else 0)
    some = counts > 0
    for name, values in {**per_char, "wide": wide, "long_words": summed(length > 12, first) / n, "short_words": summed(length <= 3, first) / n,
                         "upper_words": summed(has_upper, first) / n, "symbol_words": summed(with_symbol, first) / n}.items():
        out[some, FEATURES.index(name)] = values[some]
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> dict:
    return {"features": pa.array(list(measures(data, offsets)), pa.list_(pa.float64()))}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> boosted_gam.Gam:
    """Fit to the labelled texts; ``labels`` has the id and the label."""
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
             .groupBy("id").agg(F.min("label").alias("label")))
    # Ids with a low hash, a few less than the sample, so that no task has to sort all labels.
    share = 0.97 * sample / max(known.count(), 1)
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # At most ``sample`` rows of an id and a label are broadcast.
    chosen = map_texts(texts.join(F.broadcast(known), "id"), "text", ["id", "label"], _features, "features array<double>")
    rows = chosen.groupBy("id", "label").agg(F.min("features").alias("features")).orderBy("id").collect()
    x = np.array([r.features for r in rows]).reshape(-1, len(FEATURES))
    return boosted_gam.fit(x, np.array([r.label for r in rows], float))


def scored(docs: DataFrame, model: boosted_gam.Gam, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns) and ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data: np.ndarray, offsets: np.ndarray, m: boosted_gam.Gam) -> dict:
        return {"score": pa.array(m.score(measures(data, offsets)), pa.float64())}

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, "text", ["doc"], run, "score double", lambda: shared.value)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    rows = scored(docs, fit(docs, labels), carry=["doc_id"])
    return rows.select("doc.doc_id", held_out("doc.doc_id", 5, 0), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
