"""Helpers the text operators share: reading tables, Arrow batches as numpy, word spans and hashes.

Texts reach the kernels as the UTF-8 bytes of an Arrow column and its offsets, so no Python
string is made for a word. A null text is an empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Bytes of text a kernel hashes at a time; longer words are taken whole.
SLICE_BYTES = 1 << 20
# Texts handed to Python at a time: few rows, as one text may be long.
BATCH_ROWS = 256
# Bytes of text a kernel sees at a time, unless one text is longer.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_WHITE = [0x20, *range(0x09, 0x0E)]
WHITE = np.zeros(256, bool)
WHITE[_WHITE] = True
# ASCII letters and digits and every byte of a non-ASCII character belong to a word.
NOT_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of files."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of a batch that crosses to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def carried(docs: DataFrame, carry: list[str] | None) -> Column:
    """One struct column ``doc`` of the columns to carry along (all by default), so that no name can clash."""
    names = docs.columns if carry is None else carry
    return F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")


def map_texts(df: DataFrame, text: str, keep: list[str], kernel: Callable[..., dict], schema: str,
              state: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``kernel(data, offsets[, state])`` to batches of texts; ``keep`` columns go along.

    The kernel gets the bytes and the offsets of some texts and returns new columns, one value a
    row. ``state()`` is called once per task. Memory is bounded by ``CHUNK_BYTES`` or one text.
    """
    small_batches(df.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = () if state is None else (state(),)
        for batch in batches:
            for part in chunks(batch, len(names)):
                made = kernel(*text_buffers(part.column(len(names))), *extra)
                yield pa.RecordBatch.from_pydict({**{n: part.column(i) for i, n in enumerate(names)}, **made})

    chosen = df.select(*names, F.col(text).cast("string").alias("__text"))
    fields = [chosen.schema[n] for n in names] + StructType.fromDDL(schema).fields
    return chosen.mapInArrow(run, StructType(fields))


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its texts hold about ``CHUNK_BYTES`` at most, or are one text."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, beginning at zero."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many each text has."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separator[data], out=inside[1:-1])
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[1:-1][edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[1:-1][last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(n, U64), np.ones(n, U64)
    up[1:], down[1:] = base, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``lower`` folds A-Z first."""
    values = _BYTE[LOWER] if lower else _BYTE
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        at = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, at + SLICE_BYTES, "right")))
        n = int(ends[last - 1] - at)
        if not _POWERS or len(_POWERS[0]) < n + 1:
            _POWERS[:] = _powers(max(n, SLICE_BYTES) + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(values[data[at:at + n]] * _POWERS[0][:n], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mix((sums[b] - sums[a]) * _POWERS[1][a] + (b - a).astype(U64))
        first = last
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words beginning at each word that has so many after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n].copy()
    for i in range(1, k):
        total *= U64(0x9FB21C651E98DF25)
        total += words[i:i + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# Spark removes the shuffle files of an execution when it has ended, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again, which cuts its lineage and frees its shuffle files."""
    from fleetscope.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False)).alias("held_out")


def frequent(counted: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """The rows with the largest counts, at most ``limit``: all from the least count on for which they are so few.

    The cut is read from the counts' logarithms, a few hundred numbers, so nothing is sorted or gathered.
    """
    step = F.floor(8 * F.log2(F.col(count))).alias("step")
    sizes = sorted(counted.groupBy(step).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step)
    total, least = 0, None
    for r in sizes:
        total += r.k
        if total > limit:
            break
        least = r.step
    return counted.where(step >= (least if least is not None else 1 << 30))
