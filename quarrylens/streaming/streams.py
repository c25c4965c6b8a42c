"""Structured Streaming forms of the running operators: event-time windows with late data, and a budget as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.session import ensure_checkpoint_dir


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a table file or directory."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    ).select(F.col("window.start").alias("start"), "event_type", "n", "top")


def _spend(limit: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, rows = (state.get if state.exists else (0, 0))
        cost = events = 0
        for pdf in batches:
            cost += int(pdf["cost"].sum())
            events += len(pdf)
        state.update((spent + cost, rows + events))
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent + cost], "events": [rows + events], "over": [spent + cost > limit]})

    return run


def spending(events: DataFrame, limit: int) -> DataFrame:
    """What each user has spent so far, as state; a row per user and trigger."""
    return events.select("user_id", F.round("value").cast("long").alias("cost")).groupBy("user_id").applyInPandasWithState(
        _spend(limit), "user_id long, spent long, events long, over boolean", "spent long, events long", "update", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its output, written below the shared checkpoint folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
