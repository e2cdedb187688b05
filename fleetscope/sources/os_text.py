"""Operating-system command output, one row per line, to metrics per poll."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["host_id", "poll_id"]
AMOUNT = "DECIMAL(18,2)"
# Commands, and the places and names of their numbers.
KINDS = ["loadavg", "meminfo", "df", "sar", "iostat", "cpu", "pid", "top"]
LOAD = ["cpu_1", "cpu_5", "cpu_15"]
MEMORY = {"MemTotal": "memory_total", "MemFree": "memory_free", "Buffers": "memory_buffers",
          "Cached": "memory_cache", "SwapTotal": "swap_total", "SwapFree": "swap_free"}
MEMORY_NAME = r"^(\w+):"
MEMORY_SIZE = r"try_cast(regexp_extract(line, r':\s+(\d+)', 1) AS BIGINT)"
CPU = ["cpu_user", "cpu_nice", "cpu_system", "cpu_iowait", "cpu_steal", "cpu_idle"]
MYSQL = {"mysql_cpu": 8, "mysql_memory": 9}
NETWORK = {"net_receive_packet": (2, 1), "net_send_packet": (3, 1),
           "net_receive_byte": (4, 1024), "net_send_byte": (5, 1024)}


def _lines(df: DataFrame, kind: str) -> DataFrame:
    return (df.where(F.col("kind") == kind)
            .withColumn("f", F.split(F.trim("line"), r"\s+")))


def _field(n: int, type_name: str = AMOUNT) -> Column:
    return F.expr(f"try_cast(get(f, {n}) AS {type_name})")


def os_loadavg(df: DataFrame) -> DataFrame:
    """Load over 1, 5 and 15 minutes."""
    return _lines(df, "loadavg").select(*KEY, *[_field(n, "DOUBLE").alias(c) for n, c in enumerate(LOAD)])


def _memory_sizes(name: str, size: Column) -> dict[str, Column]:
    return ({c: F.when(F.col(name) == n, size * 1024) for n, c in MEMORY.items()}
            | {"memory_free_total": F.when(F.col(name).isin("MemFree", "Buffers", "Cached"), size * 1024)})


def os_memory(df: DataFrame) -> DataFrame:
    """Memory sizes in bytes; free total = free + buffers + cached."""
    named = df.where(F.col("kind") == "meminfo").select(*KEY, F.regexp_extract("line", MEMORY_NAME, 1).alias("name"), F.expr(MEMORY_SIZE).alias("size"))
    return named.groupBy(*KEY).agg(*[F.sum(v).alias(c) for c, v in _memory_sizes("name", F.col("size")).items()])


def _is_disk() -> Column:
    return (F.col("line_no") > 1) & ~F.col("line").contains("tmpfs")


def _disk_use() -> Column:
    return F.expr(r"try_cast(regexp_extract(line, r'(\d+)%', 1) AS BIGINT)")


def _disk_blocks() -> Column:
    return F.when(F.size("f") == 6, _field(1, "BIGINT")).when(F.size("f") == 5, _field(0, "BIGINT"))


def _whole_gigabytes(blocks: Column) -> Column:
    return F.shiftright(blocks, 20)


def os_disk(df: DataFrame) -> DataFrame:
    """Highest use in percent and total size (1K blocks / 1024 / 1024); tmpfs is left out."""
    return (_lines(df, "df").where(_is_disk())
            .groupBy(*KEY).agg(F.max(_disk_use()).alias("disk_value"), _whole_gigabytes(F.sum(_disk_blocks())).alias("total_disk_value")))


def _is_interface() -> Column:
    return F.col("line").startswith("Average") & ~F.col("line").contains("IFACE")


def os_network(df: DataFrame) -> DataFrame:
    """Average packets and bytes per second, summed over interfaces."""
    return (_lines(df, "sar").where(_is_interface()).groupBy(*KEY)
            .agg(*[(F.sum(_field(n)) * scale).cast("double").alias(c) for c, (n, scale) in NETWORK.items()]))


def _carried(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Lines of some commands; each has its fields, the last device header of its poll and the pid of its poll.

    Both are read in one window over the poll, so what is grouped by poll afterwards needs no
    further exchange and no join. A poll is the output of a few commands, never a large group.
    Lines are exchanged as they are and split behind the window; memory lines are not split.
    """
    poll = Window.partitionBy(*KEY)
    kind, line_no = F.col("kind"), F.col("line_no")
    header, is_pid = (kind == "iostat") & F.col("line").startswith("Device"), kind == "pid"
    lines = df.where(kind.isin(list(kinds))).withColumns({
        "header": F.max_by(F.when(header, F.col("line")), F.when(header, line_no)).over(poll),
        "header_line": F.max(F.when(header, line_no)).over(poll),
        "pid": F.max_by(F.when(is_pid, _first_number()), F.when(is_pid, line_no)).over(poll)})
    return lines.withColumns({
        "f": F.when(kind != "meminfo", _fields("line")),
        "names": F.when((kind == "iostat") & (line_no > F.col("header_line")), _fields("header"))})


def _fields(text: str) -> Column:
    return F.split(F.trim(text), r"\s+")


def _first_number() -> Column:
    return F.get(_fields("line"), F.lit(0)).try_cast("bigint")


def _newest(condition: Column, value: Column) -> Column:
    return F.max_by(F.when(condition, value), F.when(condition, F.col("line_no")))


def _io() -> dict[str, Column]:
    """Device numbers under their header names, summed over the last report; null in a poll without a report."""
    device = (F.col("kind") == "iostat") & (F.col("line_no") > F.col("header_line"))

    def total(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        value = F.when(at > 0, F.get("f", at - 1)).try_cast(AMOUNT)
        return F.sum(F.when(device, F.coalesce(value, F.lit(0)))).cast(AMOUNT)

    whole = {"r/s": "io_qps", "w/s": "io_tps", "rkB/s": "io_read", "wkB/s": "io_write"}
    real = {"%util": "io_util", "await": "io_await", "svctm": "io_svctm"}
    return ({c: F.floor(total(n)).cast("bigint") for n, c in whole.items()}
            | {c: total(n).cast("double") for n, c in real.items()})


def _process() -> dict[str, Column]:
    process = (F.col("kind") == "top") & (_field(0, "BIGINT") == F.col("pid"))
    return {c: _newest(process, _field(n, "DOUBLE")) for c, n in MYSQL.items()}


def os_io(df: DataFrame) -> DataFrame:
    """Device numbers found by header name in the last report, summed over devices."""
    return _carried(df, ["iostat"]).where("line_no > header_line").groupBy(*KEY).agg(*[v.alias(c) for c, v in _io().items()])


def os_cpu_process(df: DataFrame) -> DataFrame:
    """CPU split in percent, and CPU and memory of the process whose pid the host reports; polls without a CPU line are left out.

    Lines become numbers before they are exchanged, so texts and their fields are neither shuffled nor sorted.
    """
    split = (F.col("kind") == "cpu") & ~F.col("line").startswith("avg-cpu")
    is_top, is_pid = F.col("kind") == "top", F.col("kind") == "pid"
    places = {c: (split, n) for n, c in enumerate(CPU)} | {c: (is_top, n) for c, n in MYSQL.items()}
    lines = df.where(F.col("kind").isin("cpu", "pid", "top")).withColumn("f", F.split(F.trim("line"), r"\s+")).select(
        *KEY, F.when(is_top | is_pid, _field(0, "BIGINT")).alias("process"), split.alias("is_split"),
        *[F.when(kind, F.col("line_no")).alias(c) for c, kind in (("split_line", split), ("top_line", is_top), ("pid_line", is_pid))],
        *[F.when(kind, _field(n, "DOUBLE")).alias(c) for c, (kind, n) in places.items()])
    pid = F.max_by(F.when(F.col("pid_line").isNotNull(), F.col("process")), "pid_line").over(Window.partitionBy(*KEY))
    ours = F.col("process") == F.col("pid")
    return (lines.withColumn("pid", pid).groupBy(*KEY)
            .agg(*[F.max_by(c, "split_line").alias(c) for c in CPU], *[F.max_by(F.when(ours, F.col(c)), F.when(ours, F.col("top_line"))).alias(c) for c in MYSQL],
                 F.max("is_split").alias("has_cpu")).where("has_cpu").drop("has_cpu"))


def os_metrics(df: DataFrame) -> DataFrame:
    """Every metric of a poll in one row (host, poll, ts): the lines are read, exchanged and split once.

    The columns are those of the single parsers above; a command that is missing in a poll leaves its
    columns null. If a command is reported several times, load and CPU are those of the last line.
    """
    kind = F.col("kind")
    is_memory = kind == "meminfo"
    split = (kind == "cpu") & ~F.col("line").startswith("avg-cpu")
    disk, net = (kind == "df") & _is_disk(), (kind == "sar") & _is_interface()
    # What several aggregates read of a line is a column; what one reads is left to it, as Spark compiles each on its own.
    lines = (_carried(df.select(*KEY, "ts", "kind", "line_no", "line"), KINDS)
             .withColumns({"name": F.when(is_memory, F.regexp_extract("line", MEMORY_NAME, 1)), "size": F.when(is_memory, F.expr(MEMORY_SIZE)),
                           "is_split": split, "is_net": net, "is_disk": disk}))
    load = {c: _newest(kind == "loadavg", _field(n, "DOUBLE")) for n, c in enumerate(LOAD)}
    memory = {c: F.sum(v) for c, v in _memory_sizes("name", F.col("size")).items()}
    disks = {"disk_value": F.max(F.when(F.col("is_disk"), _disk_use())),
             "total_disk_value": _whole_gigabytes(F.sum(F.when(F.col("is_disk"), _disk_blocks())))}
    network = {c: (F.sum(F.when(F.col("is_net"), _field(n))) * scale).cast("double") for c, (n, scale) in NETWORK.items()}
    cpu = {c: _newest(F.col("is_split"), _field(n, "DOUBLE")) for n, c in enumerate(CPU)}
    every = load | memory | disks | network | _io() | cpu | _process()
    return lines.groupBy(*KEY).agg(F.max("ts").alias("ts"), *[v.alias(c) for c, v in every.items()])
