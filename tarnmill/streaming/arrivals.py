"""Arrivals as streams: late copies of sales lines, and cards for notices as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnmill.operators.dedup import assign_cards
from tarnmill.runtime import materialise
from tarnmill.sources.readers import read_state
from tarnmill.sources.writers import latest_version, write_version


def first_arrivals(lines: DataFrame, keys: list[str], ts: str = "ts", late: str = "7 days") -> DataFrame:
    """The first copy of each line to arrive; copies within the delay are dropped, and state older than it is too."""
    return lines.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_revenue(lines: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Lines and revenue by window of event time, emitted once the watermark has passed it (append mode)."""
    by = lines.withWatermark(ts, late).groupBy(F.window(ts, width))
    return by.agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue")).select(F.col("window.start").alias("start"), "lines", "revenue")


def follow_cards(notices: DataFrame, state_root: str, checkpoint: str, cluster: Callable[[DataFrame], DataFrame], id_col: str = "notice_id") -> StreamingQuery:
    """Keep the card state up to date: each micro-batch is clustered, matched with the state and written as its next version.

    A batch that is run again finds its own cards in the state and changes nothing.
    """
    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        kind = batch.schema[id_col].dataType.simpleString()
        state = read_state(batch.sparkSession, latest_version(batch.sparkSession, state_root), f"{id_col} {kind}, card string")
        _, after = assign_cards(materialise(cluster(batch)), state, id_col)
        write_version(after, state_root)

    return notices.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
