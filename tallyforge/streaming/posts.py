"""Streaming forms of the day buckets and day samples: extensions, the batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_counts(posts: DataFrame, ts: str = "ts", label: str = "class_label", late: str = "1 day") -> DataFrame:
    """Posts by day and label; a day closes once the watermark passes it, later rows are dropped."""
    stamped = posts.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return stamped.groupBy(F.window("__ts", "1 day").alias("w"), label).agg(F.count("*").alias("n_posts")).select(F.to_date("w.start").alias("day"), label, "n_posts")


def sessions(posts: DataFrame, user: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of a user's posts with at most ``gap`` between them."""
    stamped = posts.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return stamped.groupBy(F.session_window("__ts", gap).alias("w"), user).agg(F.count("*").alias("n_posts")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_posts")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Drains what the source holds into a memory table; for tests and small corpora."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
