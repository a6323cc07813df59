"""Exact deduplication with DataFrame functions only.

Texts are grouped by a 128-bit hash and, inside it, by their bytes: the grouping compares whole texts, so a
collision cannot merge two texts. Aggregation combines copies before the shuffle, so a group of copies of any
size sends one row a task. Each row then finds its group again by two digests; if ever two texts agreed in
both, the query would stop with an error instead of answering wrongly.

Null texts count as empty and equal to empty ones. Rows without an id take part in group sizes but are never
the row that stays, unless a group has no id at all (keep_id null, kept false). Repeated rows of one id are
rows of their own: each counts in group_size, and all rows of the kept id say so. An empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text


def _digests(text) -> list:
    return [F.unhex(F.md5(text)).alias("h"), F.unhex(F.sha2(text, 256)).alias("s")]


def groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: smallest or largest id."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = whole_text()
    rows = docs.select("doc_id", *_digests(text))
    by_text = docs.select("doc_id", text.alias("t"), *_digests(text)).groupBy("h", "s", "t").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_digest = by_text.groupBy("h", "s").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    checked = by_digest.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")))
    # one joined key: both sides are dealt anew for the join alone, so that Spark may split a large group of copies
    key = F.concat("h", "s").alias("k")
    return rows.select("doc_id", "s", key).join(checked.select(key, "keep_id", "group_size"), "k", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("s")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One whole row for each distinct text, with the columns of ``docs``; of repeated ids, the first row in the order of the other columns."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    id_last = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(c) for c in rest if c != "doc_id"])
    row = F.struct(id_last.alias("last"), F.col("doc_id").alias("doc_id"), others.alias("rest"), F.col("text").isNull().alias("no_text"))
    best = docs.groupBy(F.unhex(F.md5(whole_text())).alias("h"), whole_text().alias("t")).agg(pick(row).alias("r"))
    own = {"text": F.when(F.col("r.no_text"), F.lit(None)).otherwise(F.col("t")), "doc_id": F.col("r.doc_id")}
    return best.select(*[own.get(c, F.col(f"r.rest.`{c}`")).alias(c) if c in own else F.col(f"r.rest.`{c}`").alias(c) for c in docs.columns])
