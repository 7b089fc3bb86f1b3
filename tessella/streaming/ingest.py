"""Frames as a stream: dirty tiles, nights, bursts, and the state that follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import coverage
from ..operators.incremental import accumulate


def dirty_tile_stream(frames: DataFrame, order: int, time: str = "date_obs", late: str = "1 day") -> DataFrame:
    """npix and image_id of every frame of a stream, each frame once; frames later than `late` are dropped."""
    once = frames.withWatermark(time, late).dropDuplicatesWithinWatermark(["image_id"])
    return coverage(once, order, keep=(time,))


def nights(rows: DataFrame, time: str, by: tuple[str, ...], late: str = "1 day") -> DataFrame:
    """night (start of the day), by and n: tumbling windows of a day behind a watermark."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, "1 day"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("night"), *by, "n")


def bursts(rows: DataFrame, time: str, by: tuple[str, ...], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """start, stop, by and n: exposures that follow each other within `gap`."""
    counted = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, "n")


def into_state(path: str, samples_of: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps one folder of state per source.

    Each source's rows are one partition, and a delivery overwrites the partitions of its sources only, so a batch
    that runs again after a failure leaves the same state.
    """
    def sink(batch: DataFrame, _: int) -> None:
        state = accumulate(samples_of(batch))
        state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)

    return sink
