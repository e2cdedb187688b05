"""Numbers as the reports print them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIB = 1024


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def human_bytes(size: str | Column) -> Column:
    """Bytes with a unit: whole B, KB and M, two decimals for G and T, null from 1024 T on."""
    n = _col(size)

    def two_decimals(unit: int, name: str) -> Column:
        return F.concat((F.floor(n.cast("double") / unit * 100 + 0.5).cast("double") / 100).cast("string"), F.lit(name))

    def whole(unit: int, name: str) -> Column:
        return F.concat(F.floor(n / unit).cast("bigint").cast("string"), F.lit(name))

    return (F.when(n == 0, F.lit("0")).when(n < KIB, F.concat(n.cast("string"), F.lit("B")))
            .when(n < KIB**2, whole(KIB, "KB")).when(n < KIB**3, whole(KIB**2, "M"))
            .when(n < KIB**4, two_decimals(KIB**3, "G")).when(n < KIB**5, two_decimals(KIB**4, "T")))


def human_bytes_short(size: str | Column) -> Column:
    """Whole K or M; sizes up to 1024 keep their number with the suffix ``KB``."""
    n = _col(size)
    kib = F.floor(n.cast("double") / KIB + 0.5).cast("bigint")
    mib = F.floor(kib.cast("double") / KIB + 0.5).cast("bigint")
    return (F.when(n <= KIB, F.concat(n.cast("string"), F.lit("KB")))
            .when(kib > KIB, F.concat(mib.cast("string"), F.lit("M")))
            .otherwise(F.concat(kib.cast("string"), F.lit("K"))))


def human_count(count: str | Column) -> Column:
    """Up to 1000 as it is, up to 10000 with one decimal and ``k``, then whole ``k``."""
    n = _col(count)
    tenths = (F.floor(n.cast("double") / 100 + 0.5).cast("double") / 10).cast("string")
    return (F.when(n <= 1000, n.cast("string")).when(n <= 10000, F.concat(tenths, F.lit("k")))
            .otherwise(F.concat(F.floor(n / 1000).cast("bigint").cast("string"), F.lit("k"))))


def fixed5(value: str | Column) -> Column:
    """Five decimals, ``0`` for null."""
    v = _col(value)
    return F.when(v.isNull(), F.lit("0")).otherwise(F.format_string("%.5f", v))


def fingerprint_prefix(fingerprint: str | Column) -> Column:
    """First 35 characters."""
    return F.substring(_col(fingerprint), 1, 35)


def none_to_null(df: DataFrame) -> DataFrame:
    """Lower-case column names; text ``None`` becomes null."""
    return df.select(*[
        (F.nullif(F.col(name), F.lit("None")) if kind == "string" else F.col(name)).alias(name.lower())
        for name, kind in df.dtypes])


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))
