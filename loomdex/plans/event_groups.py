"""Queries over the event stream: groups as a batch, as a stream, and in windows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomdex.plans.session import ensure_checkpoint_dir, table


def _grouped(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("subject")).agg(
        F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event")
    )


def log_groups(spark, sf_dir):
    """(kind, subject, count, first_seen, last_seen, first_event, last_event)"""
    return _grouped(table(spark, sf_dir, "events"))


def run_available(stream: DataFrame, mode: str, spark, key: tuple[str, ...] = ()) -> DataFrame:
    """Runs a streaming aggregation over all that is available and gives what it wrote: the last whole result in complete mode, the
    last row of each key in update mode. State and results lie in the shared checkpoint folder; a batch that is run again
    replaces what it wrote."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    whole = mode == "complete"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if whole else f"{base}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if whole:
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in key]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*").select(*stream.columns)


def _stream(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    folder, name = (path, "*.parquet") if os.path.isdir(path) else (sf_dir, "events.parquet")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", name).parquet(folder)


def log_groups_stream(spark, sf_dir):
    """The same groups, from a stream."""
    return run_available(_grouped(_stream(spark, sf_dir)), "complete", spark)


def windowed_counts(spark, sf_dir):
    """(start, event_type, n): events per type and hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def windowed_counts_stream(spark, sf_dir):
    """The same from a stream with a watermark: late rows up to a day count, older state is dropped."""
    e = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return run_available(g, "update", spark, ("start", "event_type"))


def json_meta(spark, sf_dir):
    """(k, n, users): the key in the events' JSON."""
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "user_id")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (log_groups, log_groups_stream, windowed_counts, windowed_counts_stream, json_meta)}
_GROUPS = "SELECT event_type AS kind, user_id % 10 AS subject, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM events GROUP BY 1, 2"
_HOURS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
SQL = {
    "log_groups": _GROUPS,
    "log_groups_stream": _GROUPS,
    "windowed_counts": _HOURS,
    "windowed_counts_stream": _HOURS,
    "json_meta": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
}
