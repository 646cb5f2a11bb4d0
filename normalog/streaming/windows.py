"""Token windows and hourly counts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from normalog.plans import library
from normalog.sources import scratch

WINDOW = 600


def shed(turns: DataFrame, window: int) -> DataFrame:
    """(conv_id, turn, left_at): each turn once, when the tokens from it to the newest first exceed the window.

    State is the turns still inside, so it is bounded by the window. Turns of a conversation must arrive in order; those
    of one batch are sorted.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        out = []
        for t in pd.concat(list(frames)).sort_values("turn").itertuples():
            held.append((int(t.turn), int(t.tokens)))
            total = sum(n for _, n in held)
            while held and total > window:
                turn, n = held.pop(0)
                total -= n
                out.append((key[0], turn, int(t.turn)))
        state.update(([t for t, _ in held], [n for _, n in held]))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "left_at"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, left_at long", "turns array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type, each given once its hour can no longer change; rows later than that are dropped."""
    wall = events.schema["ts"].dataType
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast(wall).alias("start"), "event_type", "n")


def drained(out: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All that the stream gives for what is there now."""
    base = scratch.folder(spark, name)
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_window_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch.folder(spark, "turns")
    turns = library.run(spark, sf_dir, "SELECT conv_id, cast(turn AS bigint) AS turn, cast(tokens AS bigint) AS tokens FROM turns")
    turns.write.parquet(base)
    return drained(shed(spark.readStream.schema(turns.schema).parquet(base), WINDOW), spark, "shed")


def watermark_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return drained(hourly(source), spark, "hourly")


QUERIES = {f.__name__: f for f in (stream_window_shed, watermark_late_drop)}
SQL = {
    "watermark_late_drop": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events) GROUP BY 1, 2",
}
