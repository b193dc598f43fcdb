"""Exact duplicates by content, in built-in expressions only.

Three combining steps, each comparing whole contents and not their digests alone: rows of one map
task meet in its partial aggregation; the tasks' winners meet by (digest, salt, content), where the
salt is the task's number, so a text that makes up a third of all rows is spread over `salts`
groups; the salts' winners, at most `salts` per content, meet by digest.

Edge cases: null text counts as empty; null ids lose against any other; rows repeated with the same
id and text are one group (all marked kept by `exact_groups`, one of them left by `drop_exact`);
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import SPACE, stored


def one_space(text: Column) -> Column:
    """`text` with every run of ASCII white space replaced by one space; null counts as empty.

    The pattern leaves out runs that are one space already, which need no replacement.
    """
    run = rf"(?:\x20{SPACE}|[\x09-\x0D]){SPACE}*"
    return F.regexp_replace(F.coalesce(text, F.lit("")), run, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size) of each distinct content of `rows` (id, digest, content)."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    spread = salted.groupBy("digest", "salt", "content").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return spread.repartition("digest").groupBy("digest", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    content = one_space(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), digest(content).alias("digest"), content.alias("content"))
    whole = winners(rows, salts)
    by_digest = stored(
        whole.groupBy("digest").agg(
            F.count("*").alias("contents"),
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
        ),
        "exact-winners",
    )
    ids = rows.select("id", "digest")
    mapped = ids.join(by_digest.where("contents = 1").drop("contents"), "digest")
    clash = by_digest.where("contents > 1").select("digest")
    if not clash.isEmpty():  # only where the hash function failed; then the contents tell them apart
        several = whole.join(clash, "digest")
        mapped = mapped.unionByName(
            rows.join(several, ["digest", "content"]).select("id", "digest", "keep_id", "group_size"),
            allowMissingColumns=True)
    return mapped.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of `docs` that stay, with its columns: one of each group of equal texts."""
    kept = exact_groups(docs, id_col, text_col, salts).where("kept").select("doc_id", "text_sha256").distinct()
    own = [f"_c{i}" for i in range(len(docs.columns))]  # no column of the input can clash with ours
    key = docs.columns.index(id_col)
    rows = docs.toDF(*own)
    rows = rows.withColumn("_sha", sha256(one_space(F.col(own[docs.columns.index(text_col)]))))
    kept = kept.toDF("_id", "_sha")
    found = rows.join(kept, (rows._sha == kept._sha) & rows[own[key]].eqNullSafe(kept._id), "left_semi")
    return found.dropDuplicates(["_sha"]).select(*own).toDF(*docs.columns)
