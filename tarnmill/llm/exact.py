"""Exact deduplication by a 128-bit content hash, with byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.names import fresh


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"))
    return own.select("_id", "_norm", F.unhex(F.md5("_norm")).alias("_hash"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: _hash, _sha, keep_id (smallest id), group_size.

    Grouping is by (128-bit hash, text): the hash deals and orders the rows, and the aggregate compares the
    bytes of what meets under one hash, so a collision makes two groups. Rows are combined before the
    shuffle: a text crosses it once per map task at most, however many copies it has.
    """
    return (
        _hashed(df, id_col, text_col)
        .groupBy("_hash", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with keep_id, group_size, kept and text_sha256 (of the normalised text).

    Null text counts as empty, and empty texts equal one another. Ids may be null: a null id stays only in a
    group without other ids (keep_id is null there). Rows that repeat one id and one text are one document
    told twice: each is reported, with the same answer. An empty table gives an empty result; other columns
    are ignored, whatever their names.

    The second read carries hashes alone (no text) to the join, which adaptive execution splits where one
    group is large.
    """
    groups = duplicate_groups(df, id_col, text_col)
    rows = _hashed(df, id_col, text_col).select("_id", "_hash", F.sha2("_norm", 256).alias("_sha"))
    return rows.join(groups, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns; of equal texts only the row with the smallest id (one of them, if rows repeat)."""
    hash_, sha, keep, null = names = [fresh(df, n) for n in ("_hash", "_sha", "_keep", "_null")]
    # ids as text beside a mark for null: plain keys, so the last step finds the rows dealt as it needs them
    def told(x: Column) -> dict[str, Column]:
        return {keep: F.coalesce(x.cast("string"), F.lit("")), null: x.isNull()}

    groups = duplicate_groups(df, id_col, text_col).withColumns({hash_: F.col("_hash"), sha: F.col("_sha"), **told(F.col("keep_id"))}).select(*names)
    norm = normalised(text_col)
    rows = df.withColumns({hash_: F.unhex(F.md5(norm)), sha: F.sha2(norm, 256), **told(F.col(id_col))})
    return rows.join(groups, names, "left_semi").dropDuplicates(names).select(*[F.col(f"`{c}`") for c in df.columns])
