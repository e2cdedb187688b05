"""Ordered operators as prefix scans over slices: one plan whatever the size of a key.

A plain window sorts all rows of a key in one task, so a key with a third of the rows would be one
task's work. Here the rows of a key are cut into slices along the order. The slice is a function of
the row's leading order column (:func:`slice_number`), so nothing is counted, stored or sampled to choose it:

1. the rows are dealt out once, by key and slice, and a window per slice does the local work;
2. each slice is summed up in one row, and a window over these few rows gives what comes before each slice;
3. that row is joined to the rows of its slice, which are where and in the order the join wants them.

The summary reads the rows that were dealt out in the first step, so the input is scanned once a level.

``order`` names columns, ``-name`` for a descending one. It must identify a row within its key,
otherwise ties are arbitrary, as in any window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.session import pin

# Key and slice of a row.
PLACE = "__place"
# Whole numbers are sliced by blocks of 2^16; other numbers by 64 cells for each doubling.
BLOCK_BITS = 16
CELLS = 64
FIRST = -(1 << 62)

RUNNING = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _name(column: str) -> str:
    return column.removeprefix("-")


def _sorted(order: Sequence[str]) -> list[Column]:
    return [F.col(_name(o)).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def slice_number(df: DataFrame, column: str) -> Column:
    """A whole number that never falls along the order of ``column`` (``-name``: descending).

    Days of a time, years of a date, blocks of whole numbers, cells of relative width of other numbers, first letters of texts.
    """
    c, kind = F.col(_name(column)), df.schema[_name(column)].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_date(F.to_date(c))
    elif isinstance(kind, T.DateType):
        number = F.year(c)
    elif isinstance(kind, T.IntegralType):
        number = F.shiftright(c.cast("bigint"), BLOCK_BITS)
    elif isinstance(kind, T.NumericType):
        x = c.cast("double")
        number = F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(CELLS * F.signum(x) * F.log2(1 + F.abs(x))))
    else:
        number = F.ascii(c)
    # Missing values come first, or last in a descending order.
    number = F.when(c.isNull(), F.lit(FIRST)).otherwise(F.greatest(number.cast("bigint"), F.lit(FIRST + 1)))
    return -number if column.startswith("-") else number


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Column | None) -> DataFrame:
    """Rows dealt out by key and slice; missing keys are keys as well."""
    place = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)],
                     (slice_number(df, order[0]) if slices is None else slices).alias("slice"))
    return df.withColumn(PLACE, place).repartition(PLACE)


def _scan(dealt: DataFrame, keys: Sequence[str], local: Mapping[str, Column], per_slice: Mapping[str, Column],
          onward: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows with their ``local`` values and, as ``__before_`` columns, what the slices before theirs come to."""
    everything = F.first(F.struct(*dealt.columns))
    # The condition always holds. It makes the summary read all columns, so that it shares the rows dealt out above.
    summed = (dealt.groupBy(PLACE).agg(*[v.alias(n) for n, v in per_slice.items()], everything.alias("__all"))
              .where("__all IS NOT NULL").drop("__all"))
    earlier = (Window.partitionBy(*[F.col(f"{PLACE}.k{n}") for n in range(len(keys))]).orderBy(f"{PLACE}.slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = summed.select(PLACE, *[onward[n](F.col(n)).over(earlier).alias(f"__before_{n}") for n in per_slice])
    return dealt.select("*", *[v.alias(f"__local_{n}") for n, v in local.items()]).join(before, PLACE)


def _clean(rows: DataFrame, columns: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    return rows.select(*columns, *[v.alias(n) for n, v in values.items()])


def _window(order: Sequence[str]):
    return Window.partitionBy(PLACE).orderBy(*_sorted(order))


def _up_to_here(order: Sequence[str]):
    return _window(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _last(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
             slices: Column | None = None) -> DataFrame:
    """``lag`` by one row: ``columns`` maps new names to source columns. ``order`` must be ascending."""
    pack = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    rows = _scan(_dealt(df, keys, order, slices), keys, {"row": F.lag(pack).over(_window(order))},
                 {"row": F.max_by(pack, F.struct(*order))}, {"row": _last})
    found = F.coalesce("__local_row", "__before_row")
    return _clean(rows, df.columns, {name: found.getField(name) for name in columns})


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggregates: Mapping[str, tuple[str, str]],
            slices: Column | None = None) -> DataFrame:
    """Running ``sum``, ``min``, ``max`` or ``count``: name -> (function, column)."""
    window = _up_to_here(order)
    rows = _scan(_dealt(df, keys, order, slices), keys,
                 {name: RUNNING[fn](src).over(window) for name, (fn, src) in aggregates.items()},
                 {name: RUNNING[fn](src) for name, (fn, src) in aggregates.items()},
                 {name: RUNNING["sum" if fn == "count" else fn] for name, (fn, _) in aggregates.items()})

    kinds = rows.schema

    def both(name: str, fn: str) -> Column:
        here, before = F.col(f"__local_{name}"), F.col(f"__before_{name}")
        if fn in ("min", "max"):
            return {"min": F.least, "max": F.greatest}[fn](here, before)
        # A sum of sums of decimals is wider than a sum.
        return F.coalesce(here + before, here, before).cast(kinds[f"__local_{name}"].dataType)

    return _clean(rows, df.columns, {name: both(name, fn) for name, (fn, _) in aggregates.items()})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, slices: Column | None = None) -> DataFrame:
    """``row_number`` within ``keys``."""
    rows = _scan(_dealt(df, keys, order, slices), keys, {"n": F.row_number().over(_window(order))}, {"n": F.count("*")}, {"n": F.sum})
    return _clean(rows, df.columns, {name: F.col("__local_n").cast("bigint") + F.coalesce("__before_n", F.lit(0))})


def ranked(df: DataFrame, keys: Sequence[str], tie: str, orders: Mapping[str, str]) -> DataFrame:
    """Several row numbers within the same keys: name -> column (``-name``: descending), ties by ``tie``.

    ``df`` is stored. All orders are numbered in one scan over narrow rows (order, key, value, tie), and the
    numbers are brought back by key and tie, which must identify a row.
    """
    stored = pin(df)

    def value(column: str) -> Column:
        c = F.col(_name(column))
        if isinstance(df.schema[_name(column)].dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        # Missing values come last in a descending order, as they do in a window; whole numbers are exact up to 2^53.
        return F.coalesce(-c.cast("double"), F.lit(float("inf"))) if column.startswith("-") else c.cast("double")

    # Orders are numbers here, as a row is sorted and kept several times and carries its order twice.
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("order"), slice_number(df, column).alias("slice"), value(column).alias("value"))
                                  for n, column in enumerate(orders.values())]))
    narrow = stored.select(*keys, tie, entries.alias("e")).select(*keys, tie, "e.*")
    numbers = numbered(narrow, [*keys, "order"], ["value", tie], "n", F.col("slice"))
    wide = (numbers.select(F.struct(*keys, tie).alias("__row"), "order", "n").groupBy("__row")
            .agg(*[F.max(F.when(F.col("order") == n, F.col("n"))).alias(name) for n, name in enumerate(orders)]))
    return stored.withColumn("__row", F.struct(*keys, tie)).join(wide, "__row").drop("__row")


def filled(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str], slices: Column | None = None) -> DataFrame:
    """Last non-null value up to and including the row: new name -> source column. ``order`` must be ascending."""
    window, at = _up_to_here(order), F.struct(*order)
    rows = _scan(_dealt(df, keys, order, slices), keys, {name: _last(F.col(src)).over(window) for name, src in columns.items()},
                 {name: F.max_by(src, F.when(F.col(src).isNotNull(), at)) for name, src in columns.items()},
                 {name: _last for name in columns})
    return _clean(rows, df.columns, {name: F.coalesce(f"__local_{name}", f"__before_{name}") for name in columns})


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                k: int) -> DataFrame:
    """First ``k`` rows of every key.

    The rank filter sits directly on the window, so Spark keeps at most ``k`` rows per
    key on the map side (WindowGroupLimit) and a hot key shuffles ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__rank", F.row_number().over(window))
            .where(F.col("__rank") <= k).drop("__rank"))


def nearest_rank(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
                 percent: int, suffix: str) -> DataFrame:
    """Exact nearest-rank percentile of several bigint/decimal measures per key.

    Values are counted per (key, measure, value) first, so the ordered part runs over
    distinct values, sliced by cells of relative width. The
    counts are read several times and much smaller than the rows, so they are kept.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("decimal(28,6)").alias("v"))
        for m in measures]))
    counts = pin(df.select(*keys, entries.alias("e"))
                 .where("e.v IS NOT NULL")
                 .groupBy(*keys, F.col("e.measure").alias("measure"), F.col("e.v").alias("v"))
                 .agg(F.count("*").alias("n")))
    totals = counts.groupBy(*keys, "measure").agg(F.sum("n").alias("total"))
    part = [*keys, "measure"]
    reached = (running(counts, part, ["v"], {"cum": ("sum", "n")})
               .join(totals, part)
               .where(F.col("cum") * 100 >= F.col("total") * percent))
    return (reached.groupBy(*keys)
            .agg(*[F.min(F.when(F.col("measure") == m, F.col("v"))).alias(f"{m}{suffix}")
                   for m in measures]))
