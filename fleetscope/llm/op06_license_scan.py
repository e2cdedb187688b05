"""Licence scan by ordered signature rules, with DataFrame functions only.

Several hundred patterns (``license_rules``) stand behind a keyword prefilter: texts without any
keyword are read once, and of the others only the patterns whose keywords occur are tried. What
the patterns find are intervals of characters; one that lies inside another of the same or a higher
priority is suppressed.

Three base phrases are counted by words besides; their labels always stay.

Defined cases: null and empty texts have no words and no labels; of two equal intervals with one
priority the earlier rule stays; repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import carried, store
from fleetscope.llm.license_rules import PRIORITIES, rules

# The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
BASE_CONFIDENCE = 0.9

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _base(words: Column, n_words: Column) -> dict[str, Column]:
    """Places of the base phrases in words joined by single spaces, with one at either end."""
    number, first, last, labels = [], [], [], []
    for phrase, label in BASE:
        some = F.contains(words, F.lit(f" {phrase} "))
        parts = F.split(words, rf"(?<= ){phrase}(?= )", -1)
        number.append(F.when(some, F.size(parts) - 1).otherwise(0).cast("bigint"))
        first.append(F.when(some, _spaces(F.element_at(parts, 1)) - 1))
        last.append(F.when(some, n_words - len(phrase.split()) - (_spaces(F.element_at(parts, -1)) - 1)))
        labels.append(F.when(some, F.lit(label)))
    return {"n_base": reduce(lambda a, b: a + b, number), "first_word": F.least(*first), "last_word": F.greatest(*last),
            "base": F.array_compact(F.array(*labels))}


def _rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows, a few hundred."""
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.second).alias("second"),
                              F.lit(r.pattern).alias("pattern")) for i, r in enumerate(rules())])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def _roots() -> list[str]:
    return sorted({r.second for r in rules()})


def _hits(rows: DataFrame) -> DataFrame:
    """(row, rule, matches, gaps): of each rule that matches, the lengths of its matches and of what lies between."""
    present = F.filter(F.array(*map(F.lit, _roots())), lambda k: F.contains(F.col("words"), k))
    # The rules are a fixed list, small enough to send to every task.
    tried = (rows.select("row", "low", "words", F.explode(present).alias("second"))
             .join(F.broadcast(_rule_table(rows.sparkSession)), "second").where(F.contains("words", F.col("keyword"))))
    lengths = tried.select("row", "rule", F.transform(F.regexp_extract_all("low", F.col("pattern"), F.lit(0)), F.length).alias("matches"),
                           F.transform(F.split("low", F.col("pattern"), -1), F.length).alias("gaps"))
    return lengths.where(F.size("matches") > 0)


def _intervals(rows: DataFrame) -> DataFrame:
    """(row, rule, start, end) of every match."""
    each = (_hits(rows).select("row", "rule", F.posexplode(F.arrays_zip("matches", "gaps"))).where("col.matches IS NOT NULL")
            .select("row", "rule", "pos", F.col("col.matches").alias("match"), F.col("col.gaps").alias("gap")))
    order = Window.partitionBy("row", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("match") + F.col("gap")).over(order)
    return each.select("row", "rule", (end - F.col("match")).alias("start"), end.alias("end"))


def detections(rows: DataFrame) -> DataFrame:
    """The intervals that no interval of the same or a higher priority contains, with label and confidence."""
    known = rules()
    facts = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in known])
    found = (_intervals(rows).withColumn("fact", F.element_at(facts, F.col("rule") + 1))
             .select("row", "rule", "start", "end", "fact.label", "fact.priority", "fact.confidence"))
    # Whatever contains an interval begins no later; of those, the farthest end of each priority decides.
    before = (Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = [F.coalesce(F.max(F.when(F.col("priority") == p, F.col("end"))).over(before) >= F.col("end"), F.lit(False)) & (F.col("priority") >= p)
              for p in range(PRIORITIES)]
    return found.withColumn("inside", reduce(lambda a, b: a | b, inside)).where("NOT inside").drop("inside")


def license_scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), word counts, base places and labels, ``found`` intervals, ``labels`` and ``score``."""
    low = F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    read = docs.select(carried(docs, carry), low.alias("low"))
    inner = F.trim(F.regexp_replace("low", _GAP, " "))
    read = read.select("doc", "low", F.when(inner == "", " ").otherwise(F.concat(F.lit(" "), inner, F.lit(" "))).alias("words"))
    read = read.select("doc", "low", "words", (_spaces(F.col("words")) - 1).alias("n_words"))
    some = reduce(lambda a, b: a | b, [F.contains("words", F.lit(k)) for k in _roots()])
    kept = [F.when(some, F.col(c)).alias(c) for c in ("low", "words")]
    rows = store(read.select("doc", "n_words", *[c.alias(n) for n, c in _base(F.col("words"), F.col("n_words")).items()], *kept)
                 .withColumn("row", F.monotonically_increasing_id()), "licences")
    found = detections(rows.where("words IS NOT NULL")).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("confidence").alias("best"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "rule"))).alias("found"))
    base = F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))
    return (rows.drop("low", "words").join(found, "row", "left")
            .select("doc", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
                    F.greatest(base, F.coalesce("best", F.lit(0.0))).alias("score"), "found"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents."""
    rows = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return rows.select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
