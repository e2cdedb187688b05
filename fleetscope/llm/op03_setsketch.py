"""Near-duplicates by SetSketch registers.

A document is its set of distinct five-word shingles (A-Z folded, words cut at ASCII white
space). Each of 192 registers keeps the truncated logarithm of the least of exponentially
distributed values, so sketches merge by maximum and equal registers are likely for similar
sets. Documents with equal sets collapse first. Bands of six registers name buckets; a pair that
meets in a bucket gets a joint likelihood estimate of its similarity from the registers, and
pairs that may reach the limit are confirmed on their full sets.

No bucket is expanded into its pairs. First every member is confirmed against the most similar of
its buckets' least members, the pivots. In buckets that still hold several components every
member is compared with the pivot, and the shingles that only one of the two has are kept. Members
of different components can then be similar only through differences they share, which an
inverted index with prefix filtering finds exactly (``_meeting``). Components grow from confirmed
links only.

A pair at the limit is missed by all 32 bands with probability (1 - 0.85**6)**32 < 3e-7, and
dropped by the estimate with about the same (five standard errors).

Defined cases: a null or empty text, or one without words, has no shingles and stays alone; a
text of fewer than five words is one shingle; rows with a null id take part, and the component
is named by the least id that is not null; a row is kept if its id is the component's (null if
no row has an id), so repeated rows of one id are kept or dropped together; any other columns
travel in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import U64, WHITE, carried, chunks, hash_spans, map_texts, small_batches, store, table, text_buffers, windows, word_spans
from fleetscope.llm.graph import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
# Pairs with an estimate below this cannot reach the limit: five standard errors.
ESTIMATE = PERCENT / 100 - 5 * (0.85 * 0.15 / REGISTERS) ** 0.5
# Shingles whose registers are computed at a time.
BLOCK = 1 << 15

_RANDOM = np.random.default_rng(8).integers(1, 1 << 63, (2, REGISTERS), dtype=np.int64).astype(U64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, counts = word_spans(data, offsets, WHITE)
    words = hash_spans(data, starts, ends, lower=True)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(windows(words[a:b], min(SHINGLE, b - a))) if b > a else np.zeros(0, U64)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row a set; sets must not be empty."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    first = 0
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
        block = np.concatenate(sets[first:last])
        begin = np.concatenate([[0], np.cumsum(sizes[first:last])[:-1]])
        least = np.empty((REGISTERS, last - first), U64)
        scratch = np.empty_like(block)
        for j in range(REGISTERS):
            np.bitwise_xor(block, _FLIP[j], out=scratch)
            np.multiply(scratch, _TIMES[j], out=scratch)
            least[j] = np.minimum.reduceat(scratch, begin)
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[first:last] = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, TOP).T
        first = last
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) with known set sizes."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * grid), p(v - u * grid)
    tiny = 1e-9
    score = above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny)) + same * np.log(np.maximum(1 - more - less, tiny))
    return grid[np.arange(len(a)), score.argmax(1)]


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketches(data: np.ndarray, offsets: np.ndarray) -> dict:
    sets = shingle_sets(data, offsets)
    full = [s for s in sets if len(s)]
    rows = iter(sketch(full)) if full else iter(())
    return {"n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_key": pa.array([_key(s) for s in sets], pa.binary()),
            "registers": pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())}


def sketched(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc``, ``id``, ``n_shingles``, ``set_key`` and ``registers`` of each row."""
    rows = docs.select(carried(docs, carry), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.coalesce("id", F.xxhash64("text")))
    return map_texts(rows, "text", ["doc", "id", "row_key"], _sketches, "n_shingles bigint, set_key binary, registers binary")


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, pivot, similarity) of the pairs (a, b, pivot) whose estimate may reach the limit."""
    sizes = F.col("na") * 100 >= F.col("nb") * PERCENT, F.col("nb") * 100 >= F.col("na") * PERCENT
    left = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.to_pydict()
                a, b = (np.frombuffer(b"".join(rows[k]), np.uint16).reshape(-1, REGISTERS).astype(np.int32) for k in ("ra", "rb"))
                value = estimate(a, b, np.array(rows["na"], float), np.array(rows["nb"], float))
                yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "pivot": batch.column("pivot"), "similarity": pa.array(value)})

    joined = pairs.join(left, "a").join(right, "b").where(sizes[0] & sizes[1]).select("a", "b", "pivot", "na", "nb", "ra", "rb")
    return joined.mapInArrow(run, "a bigint, b bigint, pivot bigint, similarity double").where(F.col("similarity") >= ESTIMATE)


def _full_sets(docs: DataFrame, text: str, id_col: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (row_key, node, set_key), taken from the texts again."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.select(F.coalesce("id", F.xxhash64("text")).alias("row_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, 2):
                nodes, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh = [i for i, n in enumerate(nodes) if n not in seen]
                if fresh:
                    part = part.take(pa.array(fresh))
                    sets = shingle_sets(*text_buffers(part.column(2)))
                    good = [i for i, s in zip(fresh, sets, strict=True) if _key(s) == keys[i]]
                    made = {nodes[i]: s.tobytes() for i, s in zip(fresh, sets, strict=True) if i in set(good)}
                    seen.update(made)
                    yield pa.RecordBatch.from_pydict({"node": pa.array(list(made), pa.int64()), "shingles": pa.array(list(made.values()), pa.binary())})

    return texts.join(wanted, "row_key").select("node", "set_key", "text").mapInArrow(run, "node bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), U64) for k in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, node, n, linked, apart): whether the two reach the limit, and the shingles only one of them has."""
    left = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("sp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, good, apart = [], [], []
            for i in range(batch.num_rows):
                p, x = (np.frombuffer(batch.column(k)[i].as_buffer(), U64) for k in (2, 3))
                d = np.setxor1d(p, x, assume_unique=True)
                n.append(len(x))
                good.append(_near(len(p) + len(x), len(d)))
                apart.append(d.view(np.int64))
            yield pa.RecordBatch.from_pydict({"pivot": batch.column(0), "node": batch.column(1), "n": pa.array(n, pa.int64()),
                                              "linked": pa.array(good, pa.bool_()), "apart": pa.array(apart, pa.list_(pa.int64()))})

    both = pairs.join(sets, "node").join(left, "pivot").select("pivot", "node", "sp", "shingles")
    return both.mapInArrow(run, "pivot bigint, node bigint, n bigint, linked boolean, apart array<bigint>")


def _near(sizes: int, apart: int) -> bool:
    """Two sets reach the limit if so few elements are in one only."""
    return (100 - PERCENT) * sizes >= (100 + PERCENT) * apart


def _several(apart: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (pivot, node, n, apart, comp) of pivots whose members are of several components."""
    rows = _labelled(apart.select("pivot", "node", "n", "apart"), comps)
    groups = rows.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("pivot")
    return store(rows.join(groups, "pivot"), "members")


def _stars_of(comps: DataFrame) -> DataFrame:
    """Links that hold the components found so far together."""
    return comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))


def _meeting(rows: DataFrame) -> DataFrame:
    """(a, b, pivot): members of a pivot in different components that may reach the limit, of the rows that ``_several`` gives.

    Let D(x) be what x and the pivot differ in, and m the most two sets of such a size may differ
    in. Two members differ in D(x) xor D(y). If one of them is not linked with the pivot, they share
    at least one element of D(x) and D(y), and with |D(x)| <= |D(y)| at least |D(x)| - m / 2 and at
    least |D(y)| - m. With the elements ordered from rare to common they then share one among
    the first m / 2 + 1 of D(x) and the first m + 1 of D(y). Edits of their own, which nobody
    shares, come first, so copies of one text with edits of their own hardly meet.
    """
    elements = rows.select("pivot", "node", F.explode("apart").alias("element"))
    shared = elements.groupBy("pivot", "element").agg(F.count("*").alias("holders")).where("holders > 1")
    most = F.floor((100 - PERCENT) / (100 + PERCENT) * (F.col("n") + F.col("n") * 100 / PERCENT) + 1e-9)
    size = F.size("apart")
    small, large = (size - F.greatest(F.lit(1), F.ceil(size - m)) + 1 for m in (most / 2, most))
    lengths = rows.select("pivot", "node", "comp", "n", size.alias("size"), small.alias("small"), large.alias("large"))
    order = Window.partitionBy("pivot", "node").orderBy("holders", "element")
    placed = elements.join(shared, ["pivot", "element"]).withColumn("place", F.row_number().over(order))
    number = placed.groupBy("pivot", "node").agg(F.count("*").alias("shared"))
    largest = (rows.groupBy("pivot", "comp").agg(F.count("*").alias("k"))
               .groupBy("pivot").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest")))
    prefix = store(placed.join(lengths.join(number, ["pivot", "node"]).join(largest, "pivot"), ["pivot", "node"])
                   .withColumn("place", F.col("size") - F.col("shared") + F.col("place")).where("place <= large")
                   .select("pivot", "element", "node", "comp", "n", "size", "place", (F.col("place") <= F.col("small")).alias("short"),
                           (F.col("comp") != F.col("largest")).alias("rest")), "prefixes")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("pivot", "element", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "comp", "n", "size", "place")])

    ordered = "comp_x <> comp_y AND (size_x < size_y OR (size_x = size_y AND node_x < node_y))"
    # From their first shared element on, what is left of the shorter rest must do for all they have to share.
    enough = F.expr(f"2 * (1 + least(size_x - place_x, size_y - place_y)) >= size_x + size_y - floor({100 - PERCENT} * (n_x + n_y) / {100 + PERCENT})")
    found = [side("x", prefix.where(x)).join(side("y", prefix.where(y)), ["pivot", "element"]).where(F.expr(ordered) & enough)
             for x, y in (("short AND rest", "true"), ("short AND NOT rest", "rest"))]
    return (found[0].union(found[1]).groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
            .agg(F.min("pivot").alias("pivot")))


def _confirmed_apart(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """The pairs (a, b, pivot) that reach the limit, by what each differs from the pivot in."""
    left = apart.select("pivot", F.col("node").alias("a"), F.col("n").alias("na"), F.col("apart").alias("da"))
    right = apart.select("pivot", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("apart").alias("db"))
    both = F.size(F.array_intersect("da", "db"))
    return (pairs.join(left, ["pivot", "a"]).join(right, ["pivot", "b"])
            .where((100 - PERCENT) * (F.col("na") + F.col("nb")) >= (100 + PERCENT) * (F.size("da") + F.size("db") - 2 * both)).select("a", "b"))


def linked(docs: DataFrame, rows: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(set_key, component_id, comp) of every distinct set, ``comp`` being its class even where no id is known; ``rows`` is what ``sketched`` made, stored."""
    sets = (rows.where("n_shingles > 0").groupBy("set_key", "n_shingles", "registers")
            .agg(F.min("id").alias("least_id"), F.min("row_key").alias("row_key")))
    reps = store(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = reps.select("node", F.explode(band).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot")
    members = store(banded.join(buckets, "bucket").select("bucket", "pivot", "node"), "members")
    if members.isEmpty():
        return reps.select("set_key", F.col("least_id").alias("component_id"), F.col("node").alias("comp"))
    sketches = store(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "n_shingles", "registers"), "sketches")
    full = store(_full_sets(docs, text, id_col, reps.join(sketches.select("node"), "node", "left_semi").select("row_key", "node", "set_key")), "shingles")
    # Round one: each member against the most similar of its pivots.
    stars = store(_estimated(members.where("node <> pivot").select(F.col("node").alias("b"), F.col("pivot").alias("a"), "pivot").distinct(), sketches), "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("a"))
    comps = store(components(_confirmed(best, full)), "components")
    # Round two: buckets that still hold several components, every member against the pivot.
    placed = _labelled(members, comps)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    again = placed.join(mixed, "bucket").where("node <> pivot").select("pivot", "node").distinct()
    apart = store(_differences(again, full), "differences")
    if not apart.isEmpty():
        comps = store(components(_stars_of(comps).union(apart.where("linked").select("pivot", "node"))), "components")
        # Round three: members of one pivot that can only meet through what both differ in.
        several = _several(apart, comps)
        if not several.isEmpty():
            met = store(_confirmed_apart(_estimated(_meeting(several), sketches), apart), "links")
            comps = components(_stars_of(comps).union(met))
    named = reps.select("node", "set_key", "least_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    return named.join(least, "comp").select("set_key", "component_id", "comp")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns of each row), ``n_shingles``, ``component_id`` and ``kept``."""
    small_batches(docs.sparkSession)
    rows = store(sketched(docs, text, id_col, carry), "sketched")
    labels = linked(docs, rows.drop("doc"), text, id_col)
    alone = rows.where("n_shingles = 0").select("doc", "id", "n_shingles", F.col("id").alias("component_id"))
    grouped = rows.where("n_shingles > 0").select("doc", "id", "n_shingles", "set_key").join(labels, "set_key").select("doc", "id", "n_shingles", "component_id")
    return grouped.union(alone).select("doc", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row for each class of near-duplicates: the one of least id, known ids first, and one of several with that id.

    Rows without words are linked with nothing, so all of them stay.
    """
    rows = store(sketched(docs, text, id_col).withColumn("row", F.monotonically_increasing_id()), "sketched")
    labels = linked(docs, rows.drop("doc", "row"), text, id_col).select("set_key", "comp")
    first = (rows.where("n_shingles > 0").select("row", "id", "set_key").join(labels, "set_key")
             .groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row")).select("row"))
    alone = rows.where("n_shingles = 0").select("doc")
    return rows.select("row", "doc").join(first, "row", "left_semi").select("doc").union(alone).select("doc.*")


def op3_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc.doc_id", "n_shingles", "component_id", "kept")
