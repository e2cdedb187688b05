"""Hard-negative mining with bounds along spanning trees of anchors.

Anchors are the query set. They are sorted by a locality code and cut into blocks; each block gets a
minimum spanning tree. All rows are packed into chunks. A task takes some blocks and some chunks,
scores every root exactly, and walks the trees: a row's score with a child lies within its
score with the parent, give or take the length of the edge times the length of the row's vector.
Only rows whose interval overlaps what is asked for are scored again; the others pass
their interval on to the grandchildren. The first pass asks for the best rows of the anchor's
label, the second for rows of other labels inside the window of any of its positives. A task keeps
the best few per question, and an aggregate merges the tasks' lists.

Scores are exact integers: components become floor(256 * x).

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part, nor
do rows whose squared length exceeds 2^61, as their scores may not fit 64 bits; rows that share an id
are one row, the least by label and vector; shorter vectors, empty ones too, end in zeros; a row is not its own positive; an anchor without positives
gives no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import store, table

SCALE = 256
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 5
# A negative's score is at least this percentage of the positive's.
LEAST_PERCENT = 80
# Anchors in a tree, trees that a task holds on average, rows in a chunk, and rows of a task.
BLOCK = 512
BLOCKS_TOGETHER = 16
CHUNK = 2048
PIECE_ROWS = 131_072
# Pieces of the rows at least, so that a small table is still spread.
LEAST_PIECES = 24
LONGEST = float(1 << 61)
CODE_BITS = 32


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
              new_label: Column | None = None) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part; ``new_label`` replaces the label."""
    chosen = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"),
                         F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform("x", lambda x: F.floor(x * SCALE))
    length = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * SCALE + 1, F.lit(2.0)))
    valid = chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (length <= LONGEST))
    if new_label is not None:
        valid = valid.withColumn("label", new_label.cast("bigint"))
    least = valid.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vec"))).alias("r"))
    return least.select("vec_id", "r.label", "r.vec")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int32)
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    out[np.arange(width) < sizes[:, None]] = values
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order from the root, parent of each and length of the edge to it: Prim's minimum spanning tree."""
    n = len(vectors)
    x = vectors.astype(np.float64)
    near, parent, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, at = np.zeros(n, np.int64), 0
    for k in range(n):
        order[k] = at
        done[at] = True
        away = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = ~done & (away < near)
        near[closer], parent[closer] = away[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
    return order, parent, np.where(parent < 0, 0.0, near)


_PACKED = "first bigint, ids binary, labels binary, vectors binary, n int"
_TREE = f"{_PACKED}, parents binary, edges binary, members array<bigint>"


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    return {"first": int(ids[0]), "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(),
            "vectors": vectors.astype(np.int32).tobytes(), "n": len(ids)}


def _batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The batches (vec_id, label, vec, ...) gathered to so many rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - count)
            held.append(part)
            count += part.num_rows
            at += part.num_rows
            if count == rows:
                yield _joined(held)
                held, count = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    t = pa.Table.from_batches(held).combine_chunks()
    vec = t.column("vec").chunk(0)
    return t.column("vec_id").to_numpy(), t.column("label").to_numpy(), vec


def anchor_blocks(anchors: DataFrame, width: int, number: int) -> DataFrame:
    """The anchors in blocks of at most ``BLOCK`` near each other, parents before children, each with its tree."""
    planes = np.random.default_rng(5).choice([-1, 1], (CODE_BITS, max(1, width))).astype(np.float64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch.column("vec"), width).astype(np.float64) @ planes[:, :width].T > 0
            code = signs @ (1 << np.arange(CODE_BITS, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], names=["vec_id", "label", "vec", "code"])

    near = (anchors.mapInArrow(coded, "vec_id bigint, label bigint, vec array<bigint>, code bigint")
            .repartitionByRange(number, "code", "vec_id").sortWithinPartitions("code", "vec_id"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vec in _batches(batches, BLOCK):
            vectors = _matrix(vec, width)
            order, parent, edge = spanning_tree(vectors)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            parents = np.where(parent < 0, -1, place[parent])[order]
            yield _one_row({**_packed(ids[order], labels[order], vectors[order]), "parents": parents.astype(np.int64).tobytes(),
                            "edges": edge[order].tobytes(), "members": ids[order].tolist()})

    return near.mapInArrow(trees, _TREE)


def _one_row(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, _ARROW[n]) for n in row]))


_ARROW = {"first": pa.int64(), "n": pa.int32(), "members": pa.list_(pa.int64()),
          **{n: pa.binary() for n in ("ids", "labels", "vectors", "parents", "edges")}}


def row_chunks(rows: DataFrame, width: int) -> DataFrame:
    """All rows, packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vec in _batches(batches, CHUNK):
            yield _one_row(_packed(ids, labels, _matrix(vec, width)))

    return rows.select("vec_id", "label", "vec").mapInArrow(pack, _PACKED)


class _Scorer:
    """The trees of a task against its chunks."""

    def __init__(self, blocks: list[dict], width: int) -> None:
        self.blocks = []
        for b in blocks:
            vectors = np.frombuffer(b["vectors"], np.int32).reshape(b["n"], width)
            self.blocks.append((np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64), vectors,
                                np.frombuffer(b["parents"], np.int64), np.frombuffer(b["edges"], np.float64), b.get("asked")))
        self.width = width

    def positives(self, chunk: dict, best: dict) -> None:
        ids, labels, vectors, norms = self._chunk(chunk)

        def want(anchor: int, label: int, asked: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            rows = np.flatnonzero((labels == label) & (ids != anchor))
            if len(rows) > POSITIVES:
                # What the rows' lower bounds already promise, and what earlier chunks gave.
                floor = np.partition(low[rows], len(rows) - POSITIVES)[len(rows) - POSITIVES]
                rows = rows[high[rows] >= floor]
            known = best.get(anchor, [])
            return rows[high[rows] >= -known[-1][0]] if len(known) == POSITIVES else rows

        def take(anchor: int, asked: list, rows: np.ndarray, scores: np.ndarray) -> None:
            best[anchor] = _best(best.get(anchor, []), ids[rows], scores, POSITIVES)

        self._walk(vectors, norms, want, take)

    def negatives(self, chunk: dict, best: dict) -> None:
        ids, labels, vectors, norms = self._chunk(chunk)

        def want(anchor: int, label: int, asked: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            inside = np.zeros(len(ids), bool)
            for _, score in asked:
                inside |= (100 * high >= LEAST_PERCENT * score) & (low <= score)
            return np.flatnonzero(inside & (labels != label))

        def take(anchor: int, asked: list, rows: np.ndarray, scores: np.ndarray) -> None:
            for positive, score in asked:
                # Python's whole numbers: a hundred times a score may not fit 64 bits.
                inside = (scores >= -(-LEAST_PERCENT * score // 100)) & (scores <= score)
                if inside.any():
                    key = anchor, positive
                    best[key] = _best(best.get(key, []), ids[rows[inside]], scores[inside], NEGATIVES)

        self._walk(vectors, norms, want, take)

    def _chunk(self, chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        vectors = np.frombuffer(chunk["vectors"], np.int32).reshape(chunk["n"], self.width)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        return np.frombuffer(chunk["ids"], np.int64), np.frombuffer(chunk["labels"], np.int64), vectors, norms

    def _walk(self, vectors: np.ndarray, norms: np.ndarray, want, take) -> None:
        longest = norms.max()
        for ids, labels, anchors, parents, edges, asked in self.blocks:
            lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
            # Products of doubles are exact below 2^53; beyond it 64-bit integers are.
            kind = np.float64 if longest * lengths.max() < 2.0 ** 52 else np.int64
            mine, theirs = vectors.astype(kind), anchors.astype(kind)
            low, high = np.empty((len(ids), len(vectors))), np.empty((len(ids), len(vectors)))
            for k, parent in enumerate(parents):
                # Bounds are a little wider than they must be, for their own rounding.
                slack = 1e-9 * lengths[k] * norms
                if parent < 0:
                    exact = mine @ theirs[k]
                    low[k], high[k] = exact - slack, exact + slack
                else:
                    width = edges[k] * (1 + 1e-9) * norms + slack
                    np.subtract(low[parent], width, out=low[k])
                    np.add(high[parent], width, out=high[k])
                questions = asked[k] if asked else []
                if asked and not questions:
                    continue
                rows = want(int(ids[k]), int(labels[k]), questions, low[k], high[k])
                if not len(rows):
                    continue
                scores = exact[rows] if parent < 0 else mine[rows] @ theirs[k]
                low[k, rows], high[k, rows] = scores - slack[rows], scores + slack[rows]
                take(int(ids[k]), questions, rows, scores.astype(np.int64))


def _best(known: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` highest scores, ties by least id, as (-score, id)."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= cut], scores[scores >= cut]
        first = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[first], scores[first]
    return sorted([*known, *zip((-scores).tolist(), ids.tolist(), strict=True)])[:k]


def _paired(blocks: DataFrame, chunks: DataFrame, pieces: int, groups: int):
    """Blocks and chunks dealt to (group of blocks, piece of rows): the query set in blocks against all rows."""
    def dealt(name: str, number: int) -> Column:
        return F.pmod(F.xxhash64("first"), F.lit(number)).cast("int").alias(name)

    def every(name: str, number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    left = blocks.select("*", dealt("together", groups), every("piece", pieces))
    right = chunks.select("*", dealt("piece", pieces), every("together", groups))
    return left.groupBy("together", "piece").cogroup(right.groupBy("together", "piece"))


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for quantised ``rows``.

    ``anchor`` says which rows are anchors.
    """
    spark = rows.sparkSession
    rows = store(rows, "negatives-rows")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(anchor.cast("bigint")), F.lit(0)).alias("anchors"),
                     F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    width, number = max(1, sizes.width), -(-sizes.anchors // BLOCK)
    if not number:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    trees = store(anchor_blocks(rows.where(anchor), width, number), "negatives-trees")
    groups = -(-trees.count() // BLOCKS_TOGETHER)
    chunks = store(row_chunks(rows, width), "negatives-chunks")
    pieces = max(LEAST_PIECES, -(-sizes.n // PIECE_ROWS))

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict = {}
        if left.num_rows and right.num_rows:
            scorer = _Scorer(left.to_pylist(), width)
            for i in range(right.num_rows):
                scorer.positives(right.slice(i, 1).to_pylist()[0], best)
        flat = [(a, i, -s) for a, found in best.items() for s, i in found]
        return pa.table({"anchor_id": pa.array([x[0] for x in flat], pa.int64()), "other": pa.array([x[1] for x in flat], pa.int64()),
                         "score": pa.array([x[2] for x in flat], pa.int64())})

    found = _paired(trees, chunks, pieces, groups).applyInArrow(find_positives, "anchor_id bigint, other bigint, score bigint")
    positives = store(_merged(found, ["anchor_id"], POSITIVES), "negatives-positives")
    place = trees.select("first", F.posexplode("members").alias("at", "anchor_id"))
    asked = (place.join(positives, "anchor_id").select("first", "at", F.explode("best").alias("b"))
             .groupBy("first").agg(F.collect_list(F.struct("at", "b.other", F.col("b.score").alias("score"))).alias("questions")))
    ready = trees.join(asked, "first")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict = {}
        if left.num_rows and right.num_rows:
            blocks = left.to_pylist()
            for b in blocks:
                b["asked"] = [[] for _ in range(b["n"])]
                for q in b["questions"]:
                    b["asked"][q["at"]].append((q["other"], q["score"]))
            scorer = _Scorer(blocks, width)
            for i in range(right.num_rows):
                scorer.negatives(right.slice(i, 1).to_pylist()[0], best)
        flat = [(a, p, i, -s) for (a, p), found in best.items() for s, i in found]
        return pa.table({n: pa.array([x[k] for x in flat], pa.int64()) for k, n in enumerate(("anchor_id", "positive_id", "other", "score"))})

    hard = _paired(ready, chunks, pieces, groups).applyInArrow(find_negatives, "anchor_id bigint, positive_id bigint, other bigint, score bigint")
    ranked = _merged(hard, ["anchor_id", "positive_id"], NEGATIVES).select("anchor_id", "positive_id", F.posexplode("best").alias("k", "b"))
    scores = positives.select("anchor_id", F.explode("best").alias("p")).select("anchor_id", F.col("p.other").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return (ranked.join(scores, ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("b.other").alias("negative_id"), "positive_score",
                    F.col("b.score").alias("negative_score")))


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of the tasks' lists, each of at most ``k``."""
    listed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "other", "score"))).alias("all"))
    return listed.select(*keys, F.transform(F.slice("all", 1, k), lambda x: F.struct(x["other"].alias("other"), x["score"].alias("score"))).alias("best"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of five positives of every anchor of ``embeddings``."""
    relabelled = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), new_label=relabelled)
    return hard_negatives(rows, F.pmod("vec_id", F.lit(ANCHOR_STEP)) == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS id, r.label,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""
