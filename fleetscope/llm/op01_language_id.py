"""Language identification by nearest clustered centroid.

Texts become hashed counts of letter pairs and triples (letters folded, everything else a space),
weighted by logarithm and inverse document frequency and scaled to length one. Each language has
several centroids, found by spherical k-means; a text takes the language of the most similar one.
A text farther from it than nearly all of the centroid's own members is rejected.

Document frequencies cover all labelled training texts. The centroids are fitted on at most
``PER_LANGUAGE`` distinct labelled texts of each language, those with the least hash; a text that is delivered
many times is one. They are chosen among hashes, with a limit that Spark applies before it shuffles, and only
the chosen texts are read into the fit. A small cluster is kept, unless it lies nearer to the large clusters of
another language than to those of its own: then its labels are taken for wrong.

``rejected`` is a further column: a text far from every centroid is flagged, and still gets the nearest language.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if
nothing was learned; ties go to the language that sorts first; null languages teach nothing;
repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import carried, chunks, held_out, map_texts, small_batches, store, table, text_buffers

DIMENSIONS = 1 << 13
PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 8
# Clusters with a smaller share of their language's texts are compared with other languages.
LEAST_SHARE = 0.05
# A text is rejected beyond this quantile of its centroid's members, with some slack.
REJECT_QUANTILE, REJECT_SLACK = 0.995, 1.15
# Characters and texts counted at a time.
SLICE, GROUP = 1 << 19, 64

_PAIR = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)
_TRIPLE = np.array([0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_SHIFT = np.uint32(32 - 13)


@cache
def _letters() -> np.ndarray:
    """The folded letter of each character, a space for what is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some texts at a time: their places, whether they have a letter, and the counts of their features."""
    lengths = np.diff(offsets)
    first = 0
    while first < len(lengths):
        last = first + 1
        while last < len(lengths) and last - first < GROUP and offsets[last + 1] - offsets[first] <= SLICE:
            last += 1
        out = np.zeros((last - first) * DIMENSIONS, np.int64)
        letters = np.zeros(last - first, bool)
        text = data[offsets[first]:offsets[last]]
        at = offsets[first:last + 1] - offsets[first]
        codes = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[at]
        # A space before each text and after the last.
        symbols = np.insert(_letters()[codes], chars, np.uint32(0x20))
        owner = np.repeat(np.arange(last - first), np.diff(chars) + 1)
        np.logical_or.at(letters, owner[symbols[:-1] != 0x20], True)
        for begin in range(0, len(owner), SLICE):
            end = min(begin + SLICE, len(owner))
            s, base = symbols[begin:end + 2], owner[begin:end] * DIMENSIONS
            blank = s == 0x20
            n = len(s) - 1
            pair = (s[:-1] * _PAIR[0] + s[1:] * _PAIR[1]) >> _SHIFT
            keep = ~(blank[:-1] & blank[1:])[:len(base)]
            m = min(n, len(base))
            out += np.bincount(base[:m][keep[:m]] + pair[:m][keep[:m]], minlength=len(out))
            triple = (s[:-2] * _TRIPLE[0] + s[1:-1] * _TRIPLE[1] + s[2:] * _TRIPLE[2]) >> _SHIFT
            m = min(len(triple), len(base))
            keep = ~blank[1:-1][:m]
            out += np.bincount(base[:m][keep] + triple[:m][keep], minlength=len(out))
        yield slice(first, last), letters, out.reshape(last - first, DIMENSIONS)
        first = last


def _vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that have each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in chunks(batch, 0):
                for _, _, count in counts(*text_buffers(part.column(0))):
                    total += (count > 0).sum(0)
                    number += len(count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(total[some], number), pa.int64())})

    rows = texts.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS, np.int64)
    number = 0
    for r in rows:  # at most DIMENSIONS + 1
        if r.feature < 0:
            number = r.n
        else:
            out[r.feature] = r.n
    return number, out


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means from the mean outwards: centroids of length one, how far members lie, and their share of all."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        closest = (x @ np.array(centres).T).max(1)
        centres.append(x[closest.argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        mine = (x @ c.T).argmax(1)
        c = np.array([x[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = x @ c.T
    mine, distance = near.argmax(1), 1 - near.max(1)
    radius = np.array([np.quantile(distance[mine == j], REJECT_QUANTILE) if (mine == j).any() else 0 for j in range(len(c))])
    size = np.bincount(mine, minlength=len(c))
    some = size > 0
    return c[some].astype(np.float32), radius[some], size[some] / len(x)


def sampled(labelled: DataFrame) -> DataFrame:
    """At most ``PER_LANGUAGE`` distinct (text, lang) of each language, those with the least hash."""
    named = labelled.select("text", "lang", F.xxhash64("text").alias("hash")).where("text IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = store(named.select("lang", "hash").distinct().withColumn("place", F.row_number().over(order))
                   .where(F.col("place") <= PER_LANGUAGE).drop("place"), "language-sample")
    return named.join(chosen, ["lang", "hash"]).dropDuplicates(["lang", "hash"]).select("text", "lang")


def _well_labelled(centroids: np.ndarray, langs: list[str], shares: np.ndarray) -> np.ndarray:
    """Which centroids count: large ones, and small ones nearer to their own language than to any other."""
    large = shares >= LEAST_SHARE
    near = np.where(large[None, :], centroids @ centroids.T, -np.inf)
    same = np.array(langs)[:, None] == np.array(langs)[None, :]
    own, other = np.where(same, near, -np.inf).max(1), np.where(same, -np.inf, near).max(1)
    return large | (own >= other)


def fit(labelled: DataFrame) -> dict:
    """Learn from (text, lang): inverse document frequencies, centroids, their languages and radii."""
    number, frequency = document_frequencies(labelled)
    idf = (np.log((1 + number) / (1 + frequency)) + 1).astype(np.float32)

    def features(data: np.ndarray, offsets: np.ndarray) -> dict:
        rows = [r.astype(np.float16).tobytes() for _, _, c in counts(data, offsets) for r in _vectors(c, idf)]
        return {"vector": pa.array(rows, pa.binary())}

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float16) for v in rows["vector"].sort_values()]).astype(np.float32)
        c, radius, share = cluster(x)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.tobytes() for v in c], "radius": radius, "share": share})

    found = (map_texts(sampled(labelled), "text", ["lang"], features, "vector binary").groupBy("lang")
             .applyInPandas(centroids, "lang string, centroid binary, radius double, share double").collect())
    found.sort(key=lambda r: (r.lang, r.centroid))
    if found:
        kept = _well_labelled(np.array([np.frombuffer(r.centroid, np.float32) for r in found]), [r.lang for r in found], np.array([r.share for r in found]))
        found = [r for r, good in zip(found, kept, strict=True) if good]
    stack = np.stack([np.frombuffer(r.centroid, np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return {"idf": idf, "centroids": stack, "lang": [r.lang for r in found], "radius": np.array([r.radius for r in found])}


def predict(docs: DataFrame, model: dict, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), ``lang_pred``, ``score`` (cosine) and ``rejected``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data: np.ndarray, offsets: np.ndarray, m: dict) -> dict:
        langs, scores, rejected = [], [], []
        for _, letters, count in counts(data, offsets):
            if not m["lang"]:
                langs += ["und"] * len(count)
                scores += [0.0] * len(count)
                rejected += [True] * len(count)
                continue
            near = _vectors(count, m["idf"]) @ m["centroids"].T
            best = near.argmax(1)
            value = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
            far = 1 - value > m["radius"][best] * REJECT_SLACK
            langs += [m["lang"][b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            scores += np.where(letters, value, 0.0).tolist()
            rejected += (far | ~letters).tolist()
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, "text", ["doc"], run, "lang_pred string, score double, rejected boolean", state=lambda: shared.value)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out("doc_id", 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return predict(docs, fit(labelled), carry=["doc_id"]).select("doc.doc_id", held_out("doc.doc_id", 3, 1), "lang_pred", "score", "rejected")
