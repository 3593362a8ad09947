"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.runtime import materialise

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. With one more shard, a key stays or moves to the new one."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    while len(open_):  # each pass moves a key at least one shard ahead, so `shards` passes suffice
        at[open_] = ahead[open_]
        k = key[open_] * _STEP + np.uint64(1)
        key[open_] = k
        ahead[open_] = np.floor((at[open_] + 1) * (2147483648.0 / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return at


def jump_shard(key: str | Column, shards: int) -> Column:
    """Shard of a long key as a column; null counts as key 0."""

    @F.pandas_udf(T.IntegerType())
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(0)).cast("long"))


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row by its id: id, size, text_crc32, law, shard, slot, grown_shard (with one shard more).

    The id and the number of shards alone decide (law `key`), so equal texts under different ids may part.
    size is the text's UTF-8 bytes (null: none) plus 8. slot numbers a shard's rows without gaps in the order
    of id, then checksum; repeated rows get a slot each. Null ids come first and count as key 0. An empty
    table gives no rows; other columns are ignored.

    Slots need no single sorted task: rows are dealt by ranges of the order (ties broken at random, so that a
    repeated id spreads), each range is written with its number, and a row's slot is the number of its
    shard's rows in earlier ranges plus its rank in its own.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = df.select(F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), crc.cast("long").alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_shard(id_col, shards), "grown_shard": jump_shard(id_col, shards + 1), "_tie": F.rand(17)})
    order = [F.col(id_col).asc_nulls_first(), "text_crc32", "size", "_tie"]
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*order))
    return (
        dealt.withColumn("_rank", rank)
        .join(first, ["shard", "_range"])
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
