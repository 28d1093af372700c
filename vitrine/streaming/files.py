"""The file-change flow: events to actions, debounced, stable, applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = r"\.(jpg|jpeg|jfif|png|webp|heic|heif)$"


def file_actions(events: DataFrame) -> DataFrame:
    """created and modified are processed, deleted removed, moved both; other files are left out.  Works on streams and tables."""
    images = events.where(F.lower("path").rlike(IMAGES))
    steps = F.when(F.col("action") == "moved", F.array(F.lit("remove"), F.lit("process"))).when(F.col("action") == "deleted", F.array(F.lit("remove"))).otherwise(F.array(F.lit("process")))
    return images.withColumn("step", F.explode(steps))


def debounced(actions: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """The last action of each burst on a path: path, step, at, n.  On a stream, rows later than ``late`` are dropped."""
    rows = actions.withWatermark("at", late) if actions.isStreaming else actions
    last = F.max_by(F.struct("step", "event_id"), F.struct("at", "event_id", "step")).alias("last")
    bursts = rows.groupBy("path", F.session_window("at", gap).alias("burst")).agg(last, F.max("at").alias("at"), F.count("*").alias("n"))
    return bursts.select("path", F.col("last.step").alias("step"), "at", "n")


def action_counts(actions: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    rows = actions.withWatermark("at", late) if actions.isStreaming else actions
    return rows.groupBy(F.window("at", window).alias("w"), "step").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "step", "n")


def search_history(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One history row for each finished search (query_id), whatever the times it is told: query_path, result_count, elapsed_seconds, at.

    events: query_id, query_path, result_count, elapsed_seconds, at.  Searches
    without a path aren't kept; negative counts and times are 0.  On a stream,
    repeats that come later than ``late`` are no longer known.
    """
    rows = events.where(F.trim("query_path") != "")
    rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["query_id"]) if rows.isStreaming else rows.dropDuplicates(["query_id"])
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return rows.select("query_id", F.trim("query_path").alias("query_path"), zero("result_count").cast("int").alias("result_count"), zero("elapsed_seconds").cast("double").alias("elapsed_seconds"), "at")


def apply_to(path: str, key: str = "path"):
    """A foreachBatch function that keeps a snapshot table of the latest step per path; repeating a batch changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target, earlier = f"{path}/v{batch_id}", f"{path}/v{batch_id - 1}"
        rows = batch.select(key, "step", "at")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(earlier))
        rows.groupBy(key).agg(F.max_by("step", "at").alias("step"), F.max("at").alias("at")).write.mode("overwrite").parquet(target)

    return apply
