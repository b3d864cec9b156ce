"""Streams of events about pools and jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str, files: int = 4) -> DataFrame:
    """A stream of the Parquet files in a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, by: str, value: Column, late: str = "1 hour", width: str = "1 day", time: str = "ts") -> DataFrame:
    """begin, by, n, total of events in windows of time; windows end once no event can be late any more."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), by)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("begin"), by, "n", "total")
    )


def pool_states(events: DataFrame) -> DataFrame:
    """uniq_id, seq, state after each batch in which a pool's state changed, from events (uniq_id, seq, change).

    A pool is up, down, or lost for good once it was shrunk away; within a batch events count in order of seq (of equal
    ones shrink, then the first by name), and older ones than the last that counted are late and left out. A state is two
    values, and a batch is read in pieces that need no order, so a pool's events are never held together.
    """

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, before = state.get if state.exists else (-1, "up")
        seq, now, lost = seen, before, before == "lost"
        for batch in batches:
            fresh = batch[batch["seq"] > seen]
            if fresh.empty:
                continue
            lost = lost or bool(fresh["change"].isin(["shrink", "lost"]).any())
            last = int(fresh["seq"].max())
            change = fresh.loc[fresh["seq"] == last, "change"].min()
            if last > seq or (last == seq and change < now):
                seq, now = last, change
        if lost:
            now = "lost"
        state.update((seq, now))
        if now != before:
            yield pd.DataFrame({"uniq_id": [key[0]], "seq": [seq], "state": [now]})

    return events.groupBy("uniq_id").applyInPandasWithState(fold, "uniq_id bigint, seq bigint, state string", "seq bigint, state string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to a folder and read from it."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
