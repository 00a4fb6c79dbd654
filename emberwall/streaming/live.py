"""The same parse, enrich and filter steps over a growing folder of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import FilterSpec
from ..operators.enrich import interface_display, rule_labels
from ..operators.parse import parse_lines


def stream_lines(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_rows(spark: SparkSession, folder: str, *, spec: FilterSpec | None = None, interfaces: DataFrame | None = None, labels: DataFrame | None = None, files_per_trigger: int | None = None, **options) -> DataFrame:
    """Parsed rows of new files. Dimensions are static and joined per batch; no state is kept."""
    rows = parse_lines(stream_lines(spark, folder, files_per_trigger=files_per_trigger), **options)
    if interfaces is not None:
        rows = interface_display(rows, interfaces)
    if labels is not None:
        rows = rule_labels(rows, labels)
    return spec.apply(rows) if spec is not None else rows


def action_counts(rows: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows by window and action; later than delay is dropped. Lines without a time of their own are not counted."""
    timed = rows.where("ts is not null").withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    grouped = timed.groupBy(F.window("event_time", window), "action").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "action", "n")
