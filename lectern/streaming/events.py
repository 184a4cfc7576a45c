"""Streams of events: windows, late data, deduplication, joins and state. Each takes a streaming or a batch DataFrame,
so the same definition serves both; watermarks only matter to streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their id within the watermark (all of a batch)."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of ``first`` and events of ``second`` of the same user up to ``within`` later."""
    a = first.withWatermark("ts", late).select(F.col("event_id").alias("a"), F.col("user_id").alias("user_a"), F.col("ts").alias("ts_a"))
    b = second.withWatermark("ts", late).select(F.col("event_id").alias("b"), F.col("user_id").alias("user_b"), F.col("ts").alias("ts_b"))
    return a.join(b, F.expr(f"user_a = user_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL {within}")).select("a", "b", F.col("user_a").alias("user_id"))


def job_states(events: DataFrame) -> DataFrame:
    """The folded state of each user's job after each micro-batch (or of the whole batch): stage, progress, attempts.
    ``events``: user_id, ts, event_id, name."""
    import pandas as pd

    from ..operators.grouped import fold_job

    out = "user_id long, stage string, progress long, attempts long"
    if not events.isStreaming:
        from ..operators.grouped import per_group

        return per_group(events, ["user_id"], ["ts", "event_id"], lambda pdf: fold_job(pdf.name.tolist())[-1:], "stage string, progress long, attempts long")

    def run(key, frames, state):
        stage, progress, attempts = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        stage, progress, attempts = fold_job(rows.name.tolist(), stage, progress, attempts)[-1]
        state.update((stage, progress, attempts))
        yield pd.DataFrame([(key[0], stage, progress, attempts)], columns=["user_id", "stage", "progress", "attempts"])

    return events.groupBy("user_id").applyInPandasWithState(run, out, "stage string, progress long, attempts long", "update", "NoTimeout")
