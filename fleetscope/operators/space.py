"""Table space: sizes, fragmentation, growth, index checks and table detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.constants import SYSTEM_SCHEMAS, TABLE_PAGE_ROWS
from fleetscope.operators.ordered import previous, top_per_key

TABLE = ["host_id", "db_name", "table_name"]
SIZES = ["table_rows", "data_length", "index_length", "total_size", "auto_increment", "file_size", "free_size"]
TOTALS = ["rows_total", "data_total", "index_total", "total", "file_total", "free_total"]

# Sort keys of the two space reports; any other number sorts by free space.
HOST_ORDER = {1: "rows_total", 2: "data_total", 3: "index_total", 4: "total", 5: "file_total", 6: "free_total"}
TABLE_ORDER = {1: "table_rows", 2: "data_length", 3: "index_length", 4: "total_size", 5: "file_size", 6: "free_size",
               7: "auto_increment"}


# A table of a server: fleets have the same schemas and tables on many servers.
CATALOG_TABLE = ["host_id", "table_schema", "table_name"]


def catalog_scan(tables: DataFrame) -> DataFrame:
    """User tables only; missing sizes become 0; total and full name added."""
    sizes = {c: F.coalesce(c, F.lit(0)) for c in ("data_length", "index_length", "auto_increment")}
    return (tables.where(~F.col("table_schema").isin(SYSTEM_SCHEMAS))
            .withColumns(sizes)
            .withColumn("total_size", F.col("data_length") + F.col("index_length"))
            .withColumn("full_name", F.concat_ws(".", "table_schema", "table_name")))


def table_search(tables: DataFrame, text: str) -> DataFrame:
    """Tables whose name contains ``text`` (case-sensitive)."""
    return tables.where(F.col("table_name").contains(text))


def file_size_parse(listing: DataFrame) -> DataFrame:
    """Size listing lines ``<bytes> TAB <path>/<schema>/<table>.ibd`` to columns."""
    path = r"^(\d+)\s.*/([^/]+)/([^/]+)\.ibd$"
    return listing.select(
        "host_id", "snap_date", F.regexp_extract("line", path, 1).try_cast("bigint").alias("file_size"),
        F.regexp_extract("line", path, 2).alias("db_name"), F.regexp_extract("line", path, 3).alias("table_name"))


def table_space(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog sizes with the file size; ``free_size`` is what the file holds beyond the table."""
    return (tables.join(files, [*TABLE, "snap_date"])
            .withColumn("total_size", F.col("data_length") + F.col("index_length"))
            .withColumn("free_size", F.col("file_size") - F.col("total_size")))


def space_totals(space: DataFrame) -> DataFrame:
    """Sums per host and day."""
    sums = {"rows_total": "table_rows", "data_total": "data_length", "index_total": "index_length",
            "file_total": "file_size", "free_total": "free_size", "total": "total_size"}
    return space.groupBy("host_id", "snap_date").agg(
        F.count("*").alias("table_count"), *[F.sum(c).alias(name) for name, c in sums.items()])


def daily_space_report(totals: DataFrame) -> DataFrame:
    """Newest totals of every host."""
    rest = [c for c in totals.columns if c not in ("host_id", "snap_date")]
    return (totals.groupBy("host_id")
            .agg(F.max("snap_date").alias("snap_date"), F.max_by(F.struct(*rest), "snap_date").alias("t"))
            .select("host_id", "snap_date", "t.*"))


def _against_yesterday(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Difference to the row one day earlier. The previous row counts only if it is that day."""
    before = previous(df, keys, ["snap_date"], {"__day": "snap_date", **{f"__p_{c}": c for c in columns}})
    is_yesterday = F.col("__day") == F.date_sub("snap_date", 1)
    return (before.withColumns({f"diff_{c}": F.when(is_yesterday, F.col(c) - F.col(f"__p_{c}")) for c in columns})
            .drop("__day", *[f"__p_{c}" for c in columns]))


def daily_growth(space: DataFrame) -> DataFrame:
    """Growth per table and day; null where yesterday is missing."""
    return _against_yesterday(space, TABLE, SIZES)


def daily_growth_totals(totals: DataFrame) -> DataFrame:
    """Growth per host and day; 0 where yesterday is missing."""
    out = _against_yesterday(totals, ["host_id"], TOTALS)
    return out.withColumns({f"diff_{c}": F.coalesce(f"diff_{c}", F.lit(0)) for c in TOTALS})


def hosts_by_space(report: DataFrame, order_by: int = 6) -> DataFrame:
    """Hosts by the chosen total, highest first."""
    return report.orderBy(F.col(HOST_ORDER.get(order_by, "free_total")).desc(), "host_id")


def newest_day(space: DataFrame) -> DataFrame:
    """The rows of each host's last day."""
    last = space.groupBy("host_id").agg(F.max("snap_date").alias("snap_date"))
    return space.join(last, ["host_id", "snap_date"], "left_semi")


def tables_by_space(space: DataFrame, order_by: int = 6, page: int = 1, name: str = "",
                    host_id: int | None = None) -> DataFrame:
    """One page of 20 tables by the chosen size, highest first."""
    if host_id is not None:
        space = space.where(F.col("host_id") == host_id)
    if name:
        space = table_search(space, name)
    key = F.col(TABLE_ORDER.get(order_by, "free_size")).desc()
    return (space.orderBy(key, "host_id", "db_name", "table_name", "snap_date")
            .offset((page - 1) * TABLE_PAGE_ROWS).limit(TABLE_PAGE_ROWS))


def fragmented_top(space: DataFrame, k: int) -> DataFrame:
    """The ``k`` tables of every host and day with the most free space."""
    return top_per_key(space, ["host_id", "snap_date"], [F.col("free_size").desc(), F.col("db_name"), F.col("table_name")], k)


def no_primary_key(tables: DataFrame, statistics: DataFrame) -> DataFrame:
    """Tables without a primary key, with another engine, or with a FULLTEXT or SPATIAL index."""
    facts = statistics.groupBy(*CATALOG_TABLE).agg(
        F.max((F.col("index_name") == "PRIMARY").cast("int")).alias("has_pk"),
        F.max((F.col("index_type") == "FULLTEXT").cast("int")).alias("ft"),
        F.max((F.col("index_type") == "SPATIAL").cast("int")).alias("gis"))

    def mark(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text)).otherwise(F.lit(""))

    return (tables.where(~F.col("table_schema").isin(SYSTEM_SCHEMAS))
            .select(*CATALOG_TABLE, "engine").distinct()
            .join(facts.hint("merge"), CATALOG_TABLE, "left")
            .select(*CATALOG_TABLE, "engine",
                    mark(F.coalesce("has_pk", F.lit(0)) == 0, "NOPK").alias("nopk"),
                    mark(F.col("ft") == 1, "FULLTEXT").alias("ftidx"), mark(F.col("gis") == 1, "SPATIAL").alias("gisidx"))
            .where("engine <> 'InnoDB' OR nopk <> '' OR ftidx <> '' OR gisidx <> ''"))


def _index_columns(statistics: DataFrame) -> DataFrame:
    # An index has at most 16 columns, so its list is small however large the catalog is.
    return (statistics.groupBy(*CATALOG_TABLE, "index_name", "non_unique", "index_type")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name"))),
                             lambda x: x["column_name"]).alias("cols")))


def duplicate_indexes(statistics: DataFrame) -> DataFrame:
    """Indexes whose columns are a prefix of another index of the same table and type.

    Of equal indexes the first by name is kept, PRIMARY before all. A unique index is only
    a duplicate of an equal unique one. Each index is expanded to its prefixes (at most
    16 rows) and a window looks at the indexes that share a prefix, so indexes are never
    paired with each other and nothing is joined.
    """
    table = [*CATALOG_TABLE, "index_type"]
    prefixes = (_index_columns(statistics).where(" AND ".join(f"{c} IS NOT NULL" for c in table))
                .select(*table, "index_name", (F.col("non_unique") == 0).alias("is_unique"), "cols",
                        F.when(F.col("index_name") == "PRIMARY", F.lit("")).otherwise(F.col("index_name")).alias("place"),
                        F.explode(F.sequence(F.lit(1), F.size("cols"))).alias("n"))
                .select(*table, "index_name", "place", "is_unique", (F.size("cols") == F.col("n")).alias("whole"),
                        F.array_join(F.slice("cols", 1, F.col("n")), ",").alias("columns")))
    same = Window.partitionBy(*table, "columns")
    found = prefixes.select(
        "*", F.min(F.when(~F.col("whole"), F.col("place"))).over(same).alias("longer"),
        F.min(F.when(F.col("whole"), F.col("place"))).over(same).alias("equal"),
        F.min(F.when(F.col("whole") & F.col("is_unique"), F.col("place"))).over(same).alias("equal_unique")).where("whole")
    earlier_equal = F.when(F.col("equal") < F.col("place"), F.col("equal"))
    earlier_unique = F.when(F.col("equal_unique") < F.col("place"), F.col("equal_unique"))
    covered = F.when(F.col("is_unique"), earlier_unique).otherwise(
        F.coalesce("longer", F.when(F.col("equal_unique") != F.col("place"), F.col("equal_unique")), earlier_equal))
    return (found.withColumn("by", covered).where("by IS NOT NULL")
            .select(*CATALOG_TABLE, "index_name", "columns",
                    F.when(F.col("by") == "", F.lit("PRIMARY")).otherwise(F.col("by")).alias("covered_by")))


def table_detail(tables: DataFrame, statistics: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their indexes and columns nested.

    Both lists are bounded by the server (64 indexes of 16 columns, 4096 columns per table of a server).
    The joins are sorted ones: the lists grow with the fleet, and an estimate made before they are built is far too low.
    """
    index_infos = statistics.groupBy(*CATALOG_TABLE).agg(F.array_sort(F.collect_list(
        F.struct("index_name", "seq_in_index", "column_name", "non_unique"))).alias("index_infos"))
    column_infos = columns.groupBy(*CATALOG_TABLE).agg(F.array_sort(F.collect_list(
        F.struct("ordinal_position", "column_name", "column_type", "column_key"))).alias("column_infos"))
    return (tables.join(index_infos.hint("merge"), CATALOG_TABLE, "left")
            .join(column_infos.hint("merge"), CATALOG_TABLE, "left"))
