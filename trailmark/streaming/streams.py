"""Structured Streaming forms of the click log, qualified events, sessions, priors and trending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Policy, classify, from_recommender
from ..sources.io import CLICK_SCHEMA, clean_clicks


def click_stream(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """T1 source: the click log as a stream of files; malformed lines and unknown places are skipped."""
    return clean_clicks(spark.readStream.schema(CLICK_SCHEMA).json(path), places)


def hourly_clicks(clicks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Clicks by place and hour, repeats dropped within the watermark.

    In append mode an hour is told once, when the watermark (the latest time less `late`) has passed its end; its state goes then, and a click that comes after
    is refused.
    """
    timed = clicks.withColumn("t", F.try_to_timestamp("ts")).where("t is not null").withWatermark("t", late)
    once = timed.dropDuplicatesWithinWatermark(["ts", "location_id", "surface", "rank"]) if timed.isStreaming else timed.dropDuplicates(["ts", "location_id", "surface", "rank"])
    return once.groupBy(F.window("t", "1 hour").alias("w"), "location_id").agg(F.count("*").alias("clicks")).select(F.col("w.start").alias("hour"), "location_id", "clicks")


def qualified_stream(events: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Q1 and Q3-Q5 are stateless and run unchanged on a stream."""
    return classify(events.where(~from_recommender(events, policy.markers)), policy)


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by gaps, told in append mode once the watermark has passed their end; later rows are refused and closed sessions leave the state."""
    return events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "user_key").agg(F.count("*").alias("events")).select("user_key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def running_priors(events: DataFrame) -> DataFrame:
    """T4: priors of each place so far (update or complete mode); users by a sketch, so the state stays small."""
    return events.groupBy("location_id").agg(F.count("*").alias("interactions"), F.approx_count_distinct("user_key").alias("users"), F.sum(F.coalesce("interaction_weight", F.lit(0.5))).alias("score"))


def window_trending(events: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """T5: weight of each place in fixed event-time windows; the median cut of B7 stays a batch job.

    In update mode a window is told whenever it changes (newest() keeps the last word) and leaves the state once the watermark has passed its end.
    """
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", width).alias("w"), "location_id").agg(F.count("*").alias("events"), F.sum("quality_weight").alias("weight")).select(F.col("w.start").alias("start"), "location_id", "events", "weight")


def rebuild_on_batches(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A versioned table for each micro-batch (a repeated batch overwrites its own version)."""

    def write(batch: DataFrame, epoch: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an update-mode stream over all there is; each micro-batch's changed rows are one version under path. The same checkpoint goes on where a run has ended."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch:06d}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key among the updates under path."""
    every = spark.read.parquet(path)
    rest = [c for c in every.columns if c not in (*keys, "version")]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*keys, "_r.*")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table in memory (tests and small reports)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode stream over all there is into Parquet and read it back."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_end(events: DataFrame, operator: Callable[[DataFrame], DataFrame], time: str, marks: str, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode operator over all there is and close what is open then, so that every window and session is told; read it back.

    A second source, the folder marks, is empty at first. Once all events are in, it gets one row of the year 9999 (nulls besides its time), and
    the same checkpoint goes on: the watermark passes all windows but the mark's own, which is never told. The stream has ended then and refuses further rows.
    """
    spark, rest = events.sparkSession, [f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in events.schema if f.name != time]
    mark = spark.range(1).selectExpr(f"timestamp'9999-12-31 00:00:00' as `{time}`", *rest).select(events.columns)
    mark.where("false").write.parquet(marks)
    both = operator(events.unionByName(spark.readStream.schema(events.schema).parquet(marks)))
    run_to_table(both, path, checkpoint)
    mark.coalesce(1).write.mode("append").parquet(marks)
    return run_to_table(both, path, checkpoint)
