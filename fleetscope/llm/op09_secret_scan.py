"""Secret scan by a recursive decoding worklist.

Each text is the first layer. A layer is scanned for secrets; then whatever can be decoded in it
(percent and character escapes, base64, hexadecimal, and compressed data inside those) becomes a
layer of its own, until no layer is new. A layer already seen at its place ends a cycle. Finds in a
decoded layer are mapped back to the characters of the given text.

Defined cases: null and empty texts have no spans; a match inside another kind's match is listed
too; repeated rows are each returned; other columns travel in ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.common import carried, chunks, small_batches, table
from fleetscope.llm.secret_layers import base_spans, redacted, secret_spans

_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (the carried columns), ``base`` and ``spans`` (all), ordered, and the ``redacted`` text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(rows: list) -> pa.Array:
            return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], _ARROW)

        for batch in batches:
            for part in chunks(batch, 1):
                texts = part.column(1).to_pylist()
                base = [sorted(base_spans(t or ""), key=lambda s: (s[1], ("assign", "access", "hex").index(s[0]))) for t in texts]
                spans = [secret_spans(t or "") for t in texts]
                clean = [t if t is None else redacted(t, s) for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc": part.column(0), "base": listed(base), "spans": listed(spans), "redacted": pa.array(clean, pa.string())})

    rows = docs.select(carried(docs, carry), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc"], *StructType.fromDDL(f"base {_SPAN}, spans {_SPAN}, redacted string").fields]))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    def number(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc.doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
