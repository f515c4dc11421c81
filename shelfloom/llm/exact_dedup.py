"""Exact deduplication with DataFrame functions only.

Rows are keyed by the 128-bit MD5 of the text. Inside a key the texts
themselves are grouping values, so classes are formed by comparing bytes and a
collision of the hash splits into its texts. The aggregation combines copies
within each task before the shuffle: a text that a third of all rows repeat
leaves one row per task. The rows find their class again by both digests; only
classes of several rows are joined, and the few that hold many rows apart from
the others, so no key gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, materialize


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: Column | None = None, keep: str = "max") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalize`` is a Column to compare instead of the text (null counts as
    empty either way); ``keep`` is ``"max"`` or ``"min"``, the id that stays.
    Ids that are null never stay unless all ids of the group are null; then
    ``keep_id`` is null and all its rows are kept. Rows that repeat the kept id
    with the same text are copies of one document and are all marked kept. Texts
    of any length are compared whole. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    text = F.coalesce(normalize if normalize is not None else F.col(text_col), F.lit(""))
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"))
    both = lambda h, sha: F.concat(h, F.lit(":"), sha)
    classes = materialize(
        rows.groupBy(F.md5("body").alias("h"), "body")
        .agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select(both(F.col("h"), F.sha2("body", 256)).alias("key"), "keep_id", "group_size")
    )
    keyed = rows.select("id", F.sha2("body", 256).alias("text_sha256"), F.md5("body").alias("h")).select("id", "text_sha256", both(F.col("h"), F.col("text_sha256")).alias("key"))
    out = join_classes(keyed, classes, "key", "group_size")
    several = F.col("group_size").isNotNull()
    keep_id = F.when(several, F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (keep_id.isNull() | F.coalesce(F.col("id") == keep_id, F.lit(False))).alias("kept"), "text_sha256",
    )
