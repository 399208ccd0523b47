"""Incremental ingest as Structured Streaming: content-hash dedup, progress by watermarked windows, first-seen state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import normalise as N
from sheaf.sources.tables import shared_dir


def documents_stream(spark: SparkSession, path: str, schema, per_trigger: int = 64) -> DataFrame:
    """New parquet files under ``path`` as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose content was not seen before in the stream; the state is one hash a content."""
    return stream.where(F.col(text).isNotNull()).withColumn("sha", F.sha2(text, 256)).dropDuplicates(["sha"])


def windowed_counts(stream: DataFrame, ts: str, key: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out and the state of old windows is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


STATE, OUT = "base string, cvalue string", "cname string, label string, value string, base string, conflict boolean"


def first_seen(stream: DataFrame) -> DataFrame:
    """Each value of (cname, label, value) against the first one its key had in the stream; state: that first value."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        for pdf in batches:
            rows = []
            for value, cvalue in zip(pdf["value"], pdf["cvalue"]):
                if known is None:
                    known = (value, cvalue)
                rows.append((*key, value, known[0], known[1] != cvalue))
            yield pd.DataFrame(rows, columns=["cname", "label", "value", "base", "conflict"])
        if known is not None:
            state.update(known)

    rows = stream.select(N.canon_name("name").alias("cname"), N.ustrip("label").alias("label"), N.ustrip("value").alias("value")).withColumn("cvalue", N.canon_value("value")).where("cname <> '' and label <> '' and value <> ''")
    return rows.groupBy("cname", "label").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder, and read that table."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out-{k}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{root}/out-{last['batchId']}") if last else spark.createDataFrame([], stream.schema)


class Progress:
    """NDJSON progress of a batch of outcomes: one ``file_done`` line each and a ``summary`` at the end, also for none."""

    @staticmethod
    def lines(outcomes: DataFrame) -> DataFrame:
        done = outcomes.select(F.to_json(F.struct(F.lit("file_done").alias("event"), *outcomes.columns)).alias("line"), F.lit(0).alias("part"))
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "failed", "skipped")]
        summary = outcomes.agg(*counts).select(F.to_json(F.struct(F.lit("summary").alias("event"), "ok", "partial", "failed", "skipped")).alias("line"), F.lit(1).alias("part"))
        return done.unionByName(summary)
