"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets and tokens, in this order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet in the shared folder and reads again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import store, table
from fleetscope.llm.op02_bpe import encode
from fleetscope.llm.op03_setsketch import one_of_each
from fleetscope.llm.op05_decontamination import contamination, without_spans
from fleetscope.llm.op09_secret_scan import secrets
from fleetscope.llm.op10_quality_rules import line_rules

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their hosts' frequent lines."""
    return _with_text(line_rules(docs).where("kept"), docs, F.col("clean"), F.col("left_words") < F.col("n_words"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the one with the least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their benchmark passages; a document that was nothing else goes."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    text = without_spans("doc.text", "spans")
    return _with_text(found.where("n_hit = 0 OR n_hit < n_words"), docs, F.when(F.col("n_hit") > 0, text).otherwise(F.col("doc.text")), F.col("n_hit") > 0)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kind of each secret in its place."""
    return _with_text(secrets(docs), docs, F.col("redacted"), F.size("spans") > 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``n_tokens`` and token ``ids``."""
    return encode(docs, public_tokenizers.path(TOKENIZER)).select("doc.*", "n_tokens", "ids")


def _with_text(rows: DataFrame, docs: DataFrame, text: F.Column, changed: F.Column) -> DataFrame:
    """The columns of ``docs`` with a new text, and its length where the text changed."""
    new = {"text": text, "n_chars": F.when(changed, F.length(text).cast("bigint")).otherwise(F.col("doc.n_chars"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("secrets", secret_removal),
    ("tokens", tokens),
]

# No SQL states every stage; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
