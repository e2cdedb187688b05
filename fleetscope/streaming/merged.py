"""A merged table in Parquet that micro-batches are applied to.

Each batch becomes a sorted run, cut in hash buckets of the key. Runs are kept in levels: as soon as a
level holds ``fan_in`` runs they are merged into one run of the next level, and the last level is a
single run, the base. So a row is rewritten once a level, and a reader merges at most ``fan_in`` runs
a level and the base: reading costs the size of the table and not its history.

A manifest names the live runs and the last batch. It is written last, in one of two places by turns, so a batch
that fails half-way leaves the table as it was, and a batch that comes again changes nothing. Places of runs are
used in turn as well, with twice as many as may be live: their number is fixed, nothing has to be deleted,
and a reader of the manifest before still finds its runs.

Of a key the row with the greatest ``order`` counts. Rows of deleted keys stay as such, as an older event may
come again after them. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKET = "__bucket"
RUN = "__run"
MANIFEST = "version BIGINT, batch_id BIGINT, runs ARRAY<STRING>, turns ARRAY<INT>, schema STRING"


@dataclass(frozen=True)
class Manifest:
    """Live runs as ``level-place``, the next place of each level, and the columns of the table."""

    version: int
    batch_id: int
    runs: tuple[str, ...]
    turns: tuple[int, ...]
    schema: str

    def at(self, level: int) -> list[str]:
        return [r for r in self.runs if r.startswith(f"{level}-")]


@dataclass(frozen=True)
class MergedTable:
    """``keys`` name the key columns, ``order`` is what makes a row newer than another of its key."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    order: Column
    buckets: int = 16
    fan_in: int = 8
    levels: int = 3

    def manifest(self) -> Manifest | None:
        found = []
        for place in (0, 1):
            try:
                found += self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{place}").collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        newest = max(found, key=lambda r: r.version, default=None)
        return newest and Manifest(newest.version, newest.batch_id, tuple(newest.runs), tuple(newest.turns), newest.schema)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch, unless it or a later one is in the table already."""
        before = self.manifest() or Manifest(-1, -1, (), (0,) * (self.levels + 1), batch.schema.json())
        if batch_id <= before.batch_id:
            return
        after = self._written(before, 0, self._newest(batch), ())
        for level in range(self.levels):
            full = after.at(level)
            if len(full) < self.fan_in:
                break
            # The base takes part in every merge into it.
            merged = full + (after.at(self.levels) if level + 1 == self.levels else [])
            after = self._written(after, level + 1, self._newest(self._rows(after.schema, merged)), merged)
        self._swap(replace(after, version=before.version + 1, batch_id=batch_id))

    def read(self) -> DataFrame:
        """The newest row of every key."""
        now = self.manifest()
        if now is None:
            raise ValueError(f"{self.path} holds no merged table")
        return self._newest(self._rows(now.schema, list(now.runs)))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The newest rows of the keys of ``rows``, whose number is small: only their buckets are read."""
        now = self.manifest()
        buckets = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        some = self._runs(now.schema, list(now.runs)).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
        return self._newest(some.join(rows.select(*self.keys).distinct(), list(self.keys), "left_semi"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("__row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col("__row").getField(c).alias(c) for c in rows.columns])

    def _runs(self, schema: str, runs: Sequence[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema)).add(RUN, StringType()).add(BUCKET, IntegerType())
        place = f"{self.path}/runs"
        return self.spark.read.schema(kind).option("basePath", place).parquet(*[f"{place}/{RUN}={r}" for r in runs]).drop(RUN)

    def _rows(self, schema: str, runs: Sequence[str]) -> DataFrame:
        return self._runs(schema, runs).drop(BUCKET)

    def _written(self, now: Manifest, level: int, rows: DataFrame, gone: Sequence[str]) -> Manifest:
        """The manifest with ``rows`` as a run of ``level`` in place of the runs ``gone``."""
        name = f"{level}-{now.turns[level]}"
        (rows.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *self.keys)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/runs/{RUN}={name}"))
        turns = [t if n != level else (t + 1) % (2 * self.fan_in) for n, t in enumerate(now.turns)]
        return replace(now, runs=(*[r for r in now.runs if r not in gone], name), turns=tuple(turns))

    def _swap(self, after: Manifest) -> None:
        row = (after.version, after.batch_id, list(after.runs), list(after.turns), after.schema)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{after.version % 2}")
