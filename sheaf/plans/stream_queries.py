"""Queries that run streams over what is there and must equal the batch result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.plans.analysis_queries import identities
from sheaf.plans.registry import query
from sheaf.sources.tables import materialise, table
from sheaf.streaming import ingest as I


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream: its folder of files, or its one file by name."""
    path = f"{d}/{name}.parquet"
    batch = table(spark, d, name)
    if os.path.isdir(path):
        return I.documents_stream(spark, path, batch.schema)
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_ingest_equals_batch", "select distinct sha256(text) as sha from documents where text is not null")
def stream_ingest_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    return I.run_to_table(I.dedup(stream(spark, d, "documents").select("doc_id", "text")).select("sha"))


@query("stream_window_counts", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events where ts is not null group by 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.run_to_table(I.windowed_counts(stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").where("ts is not null"), "ts", "event_type", late="3650 days"), mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_seen")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(identities(spark, d).select("seq", "name", "label", "value"), "identity-stream")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    return I.run_to_table(I.first_seen(I.documents_stream(spark, path, rows.schema)))


@query("progress_lines")
def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.Progress.lines(table(spark, d, "ingest_log").distinct().select("pdf", F.col("status")))
