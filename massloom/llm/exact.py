"""Exact deduplication by 128-bit content hashes, with bytes compared inside each hash's group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massloom.session import Scratch

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by their content hash together with the normalised text itself, so texts that
    merely share a hash stay apart. Groups are counted before the shuffle, one row per group and
    task; each row then finds its group by hash and digest in a join whose hot keys Spark can split.

    Null text counts as empty and a null doc_id never is the smallest; a group of null ids only has
    a null keep_id, and its rows count as kept. Rows that repeat doc_id and text are all marked
    alike; ``drop_exact_copies`` leaves one of them, as of a group of null ids only. An empty table gives no rows. Other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("norm")).select("doc_id", "norm", content_hash(F.col("norm")).alias("hash"))
    groups = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # As a table, so that both sides of the join are dealt by it and a hot hash can be split.
    groups = scratch.keep(groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    members = rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return members.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the smallest doc_id; all columns stay.

    Groups are as in ``exact_groups``: by the content hash together with the normalised text, so bytes
    are compared inside a hash's group, and rows that repeat a doc_id, or have none, stay where their
    texts differ. A null doc_id comes last. Each task leaves one row of a group before the shuffle, so
    a large group does not meet in one task. A text that is its own normalised form is not kept beside it.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), normalised(F.col("text")).alias("norm"))
    same = F.col("row.text").eqNullSafe(F.col("norm"))
    held = [F.when(~same, F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rows = rows.select(F.struct(*held).alias("row"), "norm", content_hash(F.col("norm")).alias("hash"), same.alias("same"))
    text = F.when(F.col("same"), F.col("norm")).otherwise(F.col("row.text"))
    first = F.row_number().over(Window.partitionBy("hash", "norm").orderBy(F.col("row.doc_id").asc_nulls_last(), text.isNull(), text))
    kept = rows.withColumn("nth", first).filter("nth = 1")
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
