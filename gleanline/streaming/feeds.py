"""Landed payloads as a stream: validated, without repeats, normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.normalise import normalise
from ..sources.raw import check


def stream_postings(spark: SparkSession, folder: str, max_files: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(valid postings, quarantined lines) of JSON-lines files as they land in `folder`."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return check(lines)


def without_repeats(postings: DataFrame, horizon: str = "2 days") -> DataFrame:
    """Drop repeats of (source, external_id) that arrive within the horizon; state is forgotten after it.

    The watermark follows the time of arrival. A posting's own date says nothing about when it lands: old or undated
    ones are as new to the stream as others and are never late.
    """
    arrived = postings.withColumn("_arrived_at", F.current_timestamp()).withWatermark("_arrived_at", horizon)
    return arrived.dropDuplicatesWithinWatermark(["source", "external_id"]).drop("_arrived_at")


def normalised(postings: DataFrame) -> DataFrame:
    """The normalisation projection is stateless, so the stream uses the batch expression as it is."""
    return normalise(postings)
