"""State of streams: the checks of a source per time slot, and sightings that expire by timer.

State is keyed so that no source and no listing is a bottleneck. The checks of a busy source are spread
over its time slots, which are summed up when the table is read; what holds for a whole source is put
together from one row per slot. Sightings are reduced per batch, with partial aggregation, before they meet their state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from lumenmart.operators import health
from lumenmart.sources.keyed_table import KeyedTable

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: The watermark trails the clock of the sightings by this much, so rows of the newest batch are never late.
CLOCK_LAG_MS = 1000


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on disk, not in executor memory."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def slot_summaries(checks: DataFrame) -> DataFrame:
    """What later readers need of the checks of every source and slot, one row each, put in time order here.

    Checks that tell something are kept in ``telling``: the first of each kind of problem (or of health) in a
    row, and those that raise the severity within it. Every other check is counted with the telling one before
    it, which also remembers the last failure it covers. ``checks``: source_id, slot, at, check_id, status,
    kind (empty: healthy), severity_rank.
    """
    ordered = Window.partitionBy("source_id", "slot").orderBy("at", "check_id")
    upto, before = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.col("status") == "FAILED", F.lit(False))
    rank = F.coalesce("severity_rank", F.lit(0))
    rows = checks.withColumn("place", F.row_number().over(ordered)).withColumn("same", F.coalesce(F.lag("kind").over(ordered) == F.col("kind"), F.lit(False)))
    rows = rows.withColumn("piece", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(upto))
    # pieces are numbered upwards, so the greatest pair is the severity reached in the piece at hand, if it began before
    rows = rows.withColumn("top", F.max(F.struct(F.col("piece"), rank.alias("rank"))).over(before))
    tells = ~F.col("same") | ((F.col("kind") != "") & (rank > F.col("top.rank")))
    rows = rows.withColumn("told", F.sum(tells.cast("int")).over(upto))
    covered = rows.groupBy("source_id", "slot", "told").agg(
        F.min(F.struct("at", "check_id", "status", "kind", "severity_rank")).alias("first"), F.count(F.lit(1)).alias("covers"),
        F.max(F.when(failed, F.struct("at", "check_id"))).alias("failure"), F.max(F.struct("at", "check_id", "status")).alias("last"),
        F.max(F.when(~failed, F.struct("at", "place"))).alias("success"))
    telling = F.struct("first.*", "covers", F.col("failure.at").alias("failed_at"), F.col("failure.check_id").alias("failed_id"))
    slots = covered.groupBy("source_id", "slot").agg(
        F.sum("covers").alias("checks"), F.max("last").alias("last"), F.max("success").alias("success"), F.sort_array(F.collect_list(telling)).alias("telling"))
    return slots.select(
        "source_id", "slot", "checks", F.col("last.at").alias("last_at"), F.col("last.check_id").alias("last_id"), F.col("last.status").alias("last_status"),
        F.col("success.at").alias("last_success_at"), (F.col("checks") - F.coalesce("success.place", F.lit(0))).alias("trailing_failures"), "telling")


class SlotTable(KeyedTable):
    """Checks by source and slot, kept as they came; read as the slots' summaries."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        # every check is a key of its own, so runs merge by being put together
        super().__init__(spark, path, lambda rows: rows)

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        return slot_summaries(super().read(schema))


def run_slot_checks(checks: DataFrame, path: str, checkpoint: str, slot_seconds: int = health.SLOT_SECONDS) -> SlotTable:
    """Run a stream of checks into the table of slots; checks may arrive in any order and however late.

    ``checks``: check_id, source_id (case does not matter), checked_at, status, error_type (null: healthy),
    severity_rank. A batch costs what it brings and never reads what came before; runs merge as they grow in
    number. A read shuffles the checks once, by source and slot.
    """
    table = SlotTable(checks.sparkSession, path)
    at = F.unix_micros(F.col("checked_at").cast("timestamp"))
    rows = checks.select(
        F.lower("source_id").alias("source_id"), F.floor(at / F.lit(slot_seconds * 1_000_000)).alias("slot"), at.alias("at"), "check_id", "status",
        F.coalesce("error_type", F.lit("")).alias("kind"), F.col("severity_rank").cast("int").alias("severity_rank"))
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.commit).start().awaitTermination()
    return table


def source_state(slots: DataFrame) -> DataFrame:
    """Current status, failure streak, last success and number of checks of every source, from its slot summaries.

    Only aggregates that combine before the shuffle: the streak is what fails after the last success of the
    newest slot that has one, plus all of later slots.
    """
    known = slots.groupBy("source_id").agg(
        F.max_by("last_status", F.struct("last_at", "last_id")).alias("status"), F.max("last_success_at").alias("success"),
        F.max(F.when(F.col("last_success_at").isNotNull(), F.col("slot"))).alias("from_slot"), F.sum("checks").alias("checks"))
    later = slots.select("source_id", "slot", "trailing_failures").join(known, "source_id").where(F.col("from_slot").isNull() | (F.col("slot") >= F.col("from_slot")))
    return later.groupBy("source_id").agg(
        F.first("status").alias("status"), F.sum("trailing_failures").alias("consecutive_failures"),
        F.timestamp_micros(F.first("success")).alias("last_success_at"), F.first("checks").alias("checks"))


def incident_lifecycle(slots: DataFrame) -> DataFrame:
    """Incidents with their whole life, from the telling checks of the slot summaries.

    source_id, incident_no, occurred_at, checks, error_type, severity_rank, resolved, resolved_at (the check
    that was healthy or opened the next incident), and for the incident of a source's last failure its
    proposal (``latest_proposal``) with the probable cause.
    """
    told = slots.select("source_id", F.explode("telling").alias("t")).select(
        "source_id", F.col("t.check_id").alias("check_id"), F.timestamp_micros("t.at").alias("checked_at"), F.col("t.status").alias("status"),
        F.nullif(F.col("t.kind"), F.lit("")).alias("error_type"), F.col("t.severity_rank").alias("severity_rank"),
        F.col("t.covers").alias("covers"), F.struct("t.failed_at", "t.failed_id").alias("failure"))
    return health.incident_lives(told)


SIGHTING_SCHEMA = "duplicate_key string, first_ms long, last_ms long, clock timestamp"
EXPIRY_SCHEMA = "duplicate_key string, first_ms long, last_ms long, active boolean, changes long"
_EXPIRY_ROW = Row("duplicate_key", "first_ms", "last_ms", "active", "changes")


class Sightings(StatefulProcessor):
    """When a listing was first and last seen; a timer at the end of its life, put off by every newer sighting."""

    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = [(r.first_ms, r.last_ms) for r in rows]
        first, last = min(r[0] for r in batch), max(r[1] for r in batch)
        known = self.seen.get() if self.seen.exists() else None
        newer = known is None or last > known[1]
        if known is not None:
            first, last = min(first, known[0]), max(last, known[1])
        changes = (known[2] if known else 0) + 1
        self.seen.update((first, last, changes))
        if newer:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # stale means: the clock is past last + stale; the watermark trails the clock
            due = last + self.stale_ms - CLOCK_LAG_MS + 1
            self.handle.registerTimer(due)
            yield _EXPIRY_ROW(*key, first, last, timerValues.getCurrentWatermarkInMs() < due, changes)
        elif first < known[0]:
            due = last + self.stale_ms - CLOCK_LAG_MS + 1
            yield _EXPIRY_ROW(*key, first, last, timerValues.getCurrentWatermarkInMs() < due, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, changes = self.seen.get()
        self.seen.update((first, last, changes + 1))
        yield _EXPIRY_ROW(*key, first, last, False, changes + 1)

    def close(self) -> None:
        pass


def reduce_sightings(records: DataFrame, folder: str, checkpoint: str) -> None:
    """Log first and last sighting per key of every batch, with the clock: the newest sighting of any batch so far.

    ``records``: duplicate_key, seen_at. However often a batch sees a listing, one row of it goes on. Replays
    overwrite their own batch.
    """
    spark = records.sparkSession

    def log(batch: DataFrame, number: int) -> None:
        # to the nearest millisecond, halves away from zero: cutting would set a time short of a full second into the one before
        seen = F.round(F.unix_micros(F.col("seen_at").cast("timestamp")) / 1000).cast("long")
        rows = batch.groupBy("duplicate_key").agg(F.min(seen).alias("first_ms"), F.max(seen).alias("last_ms"))
        clock = batch.agg(F.max(seen)).first()[0]
        before = spark.read.schema(SIGHTING_SCHEMA).parquet(f"{folder}/batch={number - 1}").agg(F.unix_millis(F.max("clock"))).first()[0] if number else None
        now = max((value for value in (clock, before) if value is not None), default=0)
        rows.withColumn("clock", F.timestamp_millis(F.lit(now))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(log).start()
    run.awaitTermination()


def run_expiry(spark: SparkSession, folder: str, path: str, checkpoint: str, stale_days: int) -> KeyedTable:
    """Run the log of `reduce_sightings` through the state; the table tells which listings are active.

    A listing unseen for longer than ``stale_days`` by the clock turns inactive by its timer, without a row
    of its own; a later sighting revives it. Event time is the clock of the log, so no sighting is dropped as
    late: an old one only sets the first sighting.
    """
    table = KeyedTable.of_changes(spark, path, ["duplicate_key"], ["changes"])
    log = spark.readStream.schema(SIGHTING_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    with rocksdb_state(spark):
        timed = log.withWatermark("clock", f"{CLOCK_LAG_MS} milliseconds")
        stream = timed.groupBy("duplicate_key").transformWithState(Sightings(stale_days * 86_400_000), EXPIRY_SCHEMA, "update", "eventtime")
        run = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.commit).start()
        run.awaitTermination()
    return table


def listing_state(table: KeyedTable) -> DataFrame:
    """duplicate_key, first_seen_at, last_seen_at, active."""
    return table.read().select("duplicate_key", F.timestamp_millis("first_ms").alias("first_seen_at"), F.timestamp_millis("last_ms").alias("last_seen_at"), "active")


def write_fresh_alerts(alerts: DataFrame, path: str, checkpoint: str, key: str = "deduplication_key") -> None:
    """Log each alert key once, however long ago it was sent.

    Sent keys are state on disk, looked up one by one, so a batch costs what it brings and not what was ever
    sent. Of equal keys in one batch any row is taken. Each batch overwrites its own folder when replayed.
    """
    with rocksdb_state(alerts.sparkSession):
        fresh = alerts.dropDuplicates([key])
        run = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
        run.awaitTermination()
