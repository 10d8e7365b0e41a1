"""Structured Streaming jobs over feed folders.

Results of stateful queries leave as change logs: every micro-batch writes only
the rows it changed into its own folder, so a replayed batch overwrites itself
and no batch rewrites the table. ``current`` reads the newest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenmart.operators import health, ingest, listings, notify
from lumenmart.sources.keyed_table import KeyedTable


def read_feed(spark: SparkSession, folder: str, schema, pattern: Optional[str] = None, files_per_batch: int = 1000, kind: str = "parquet") -> DataFrame:
    """Stream of the files that appear in a feed folder."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def write_changes(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Run all available input and log the changed rows of every batch."""
    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(log).start()
    run.awaitTermination()


def write_keyed(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "update") -> None:
    """Run all available input into a keyed table, whose runs merge as they grow in number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.commit).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest logged row per key."""
    log = spark.read.parquet(path)
    columns = [name for name in log.columns if name not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(*keys, "row.*")


def upsert_stream(records: DataFrame) -> DataFrame:
    """Keyed upsert as a streaming aggregation: the state store keeps one row per key.

    Minimum, maximum and latest-by are order-free, so late files change nothing
    that newer ones decided, and partial aggregation absorbs hot keys.
    """
    return records.groupBy("duplicate_key").agg(
        F.min_by("record_id", F.struct("seen_at", "event_id")).alias("listing_id"),
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"),
        F.max_by("price", F.struct("seen_at", "event_id")).alias("price"),
    )


def write_digest(alerts: DataFrame, path: str, checkpoint: str, at: str, width: str, *keys: str) -> None:
    """Log the digest counts of every batch; late rows count like others, whatever their batch."""
    def log(batch: DataFrame, number: int) -> None:
        counted = notify.digest(batch, at, width, *keys).select(F.col("window.start").alias("digest_start"), *keys, "alerts")
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    alerts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(log).start().awaitTermination()


def digest_totals(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("digest_start", *keys).agg(F.sum("alerts").alias("alerts"))


CHECK_COLUMNS = ("check_id", "source_id", "checked_at", "status", "error_type", "severity_rank")


def incident_stream(checks: DataFrame, path: str, state_path: str, checkpoint: str) -> None:
    """Incident lifecycle over micro-batches, right for checks that arrive in any order.

    The state is the log of checks. A batch numbers the incidents of the sources it
    touches anew, in event time, and logs only those; untouched sources keep their
    rows. State and output are written per batch number and replay safely.
    """
    spark = checks.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.select(*CHECK_COLUMNS).write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        log = spark.read.parquet(state_path).where(F.col("batch") <= number)
        touched = log.where(F.col("batch") == number).select("source_id").distinct()
        rows = log.join(touched, "source_id", "left_semi").select(*CHECK_COLUMNS)
        numbered = health.incidents(rows).select("source_id", "incident_no", "check_id", "checked_at", "status", "error_type", "severity_rank", "starts")
        numbered.write.mode("overwrite").parquet(f"{path}/batch={number}")
        touched.write.mode("overwrite").parquet(f"{path}-touched/batch={number}")

    checks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def incident_log(spark: SparkSession, path: str) -> DataFrame:
    """Problem checks with their incident number: for each source those of the last batch that touched it."""
    last = spark.read.parquet(f"{path}-touched").groupBy("source_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(path).join(last, ["source_id", "batch"], "left_semi").drop("batch")


def live_listings(spark: SparkSession, path: str) -> KeyedTable:
    """The stored live listings below a folder."""
    return KeyedTable(spark, f"{path}/live", listings.fold_batches)


def ingest_stream(records: DataFrame, sources: DataFrame, catalog: DataFrame, aliases: DataFrame, watches: DataFrame, path: str, checkpoint: str, now: Column) -> None:
    """The whole ingest run per micro-batch; each batch adds its listings to the live table and logs its errors."""
    table = live_listings(records.sparkSession, path)

    def step(batch: DataFrame, number: int) -> None:
        done = ingest.run(batch, sources, catalog, aliases, watches, None, now)
        table.commit(done.batch, number)
        done.errors.write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def live_table(spark: SparkSession, path: str) -> DataFrame:
    """The live table as of the last batch."""
    return live_listings(spark, path).read().drop("first_batch", "batch")
