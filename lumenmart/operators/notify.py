"""Alert candidates, deduplication, deferral and counters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.operators.decision import strings_or_empty

# Severity levels and the severity of each kind of alert.
SEVERITY_LEVEL = {"INFO": 0, "NOTICE": 1, "IMPORTANT": 2, "CRITICAL": 3}


@dataclass(frozen=True)
class Preference:
    minimum_severity: str = "NOTICE"
    minimum_recognition_confidence: int = 75
    maximum_price: Optional[float] = None
    maximum_price_currency: Optional[str] = None
    active_wishlist_only: bool = True
    new_listing: bool = True
    price_below_target: bool = True
    high_confidence_match: bool = False
    connector_failure: bool = True
    connector_recovery: bool = True
    digest_mode: str = "IMMEDIATE"
    quiet_start: Optional[str] = None
    quiet_end: Optional[str] = None


def _alert(kind: str, severity: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("notification_type"), F.lit(severity).alias("severity"), key.alias("deduplication_key"))


def _at_least(severity: Column, minimum: str) -> Column:
    return severity.isin(*[name for name, level in SEVERITY_LEVEL.items() if level >= SEVERITY_LEVEL[minimum]])


def listing_alerts(listings: DataFrame, pairs: DataFrame, preference: Preference = Preference()) -> DataFrame:
    """Alert candidates of active listings and the watches that matched them."""
    kind = "inner" if preference.active_wishlist_only else "left"
    rows = listings.join(pairs, "listing_id", kind).where(
        F.col("active") & (F.col("recognition_confidence") >= preference.minimum_recognition_confidence))
    watch_id = F.coalesce(F.col("watch.watch_id"), F.lit("catalog"))
    note = F.lit("")
    if preference.maximum_price is not None:
        compared = F.coalesce(F.col("currency") == F.lit(preference.maximum_price_currency), F.lit(False))
        rows = rows.where(~(compared & F.coalesce(F.col("price") > preference.maximum_price, F.lit(False))))
        note = F.when(compared, "maximum compared").otherwise("currency mismatch; maximum not compared")
    critical = F.exists(strings_or_empty("warnings"), lambda warning: F.contains(F.lower(warning), F.lit("critical")))
    target = F.col("watch.max_price")
    candidates = [
        F.when(F.lit(preference.new_listing), _alert("NEW_MATCH", "NOTICE", F.concat_ws(":", F.lit("NEW_MATCH"), "listing_id", watch_id))),
        F.when(
            F.lit(preference.high_confidence_match) & (F.col("recognition_confidence") >= 90) & (F.col("description_confidence") >= 80) & ~critical,
            _alert("HIGH_CONFIDENCE_MATCH", "IMPORTANT", F.concat_ws(":", F.lit("HIGH_CONFIDENCE_MATCH"), "listing_id", watch_id))),
        F.when(
            F.lit(preference.price_below_target) & target.isNotNull() & (F.col("currency") == F.col("watch.currency")) & (F.col("price") <= target),
            _alert("PRICE_BELOW_TARGET", "IMPORTANT", F.concat_ws(
                ":", F.lit("PRICE_BELOW_TARGET"), "listing_id", watch_id, "watch.currency", F.format_string("%.2f", target)))),
    ]
    alerts = rows.select("listing_id", "product_id", F.explode(F.array_compact(F.array(*candidates))).alias("a"), note.alias("note"))
    return alerts.select("listing_id", "product_id", "a.*", "note").where(_at_least(F.col("severity"), preference.minimum_severity))


def run_alerts(runs: DataFrame) -> DataFrame:
    """Alerts for partial and failed runs."""
    kind = F.when(F.col("status") == "PARTIAL", "RADAR_PARTIAL").when(F.col("status") == "FAILED", "RADAR_FAILED")
    return runs.withColumn("notification_type", kind).where("notification_type is not null").select(
        "notification_type", F.when(F.col("status") == "PARTIAL", "IMPORTANT").otherwise("CRITICAL").alias("severity"),
        F.concat_ws(":", "notification_type", F.col("run_id").cast("string")).alias("deduplication_key"))


def health_alerts(transitions: DataFrame, preference: Preference = Preference()) -> DataFrame:
    """Alerts for sources that just failed or recovered (previous_status, status)."""
    failed = (F.col("status") == "FAILED") & (F.coalesce("previous_status", F.lit("")) != "FAILED") & F.lit(preference.connector_failure)
    recovered = (F.col("status") == "HEALTHY") & (F.col("previous_status") == "FAILED") & F.lit(preference.connector_recovery)
    kind = F.when(failed, "CONNECTOR_FAILED").when(recovered, "CONNECTOR_RECOVERED")
    return transitions.withColumn("notification_type", kind).where("notification_type is not null").withColumn(
        "severity", F.when(F.col("notification_type") == "CONNECTOR_FAILED", "CRITICAL").otherwise("NOTICE")).withColumn(
        "deduplication_key", F.concat_ws(":", "notification_type", "source_id", F.when(F.col("status") == "FAILED", "failed").otherwise("healthy")))


def review_alerts(decisions: DataFrame) -> DataFrame:
    """Alerts for decisions that ask for a manual review and give a reason."""
    return decisions.where((F.col("recommendation") == "MANUAL_REVIEW") & (F.size("reasons") > 0)).select(
        F.lit("MANUAL_REVIEW_REQUIRED").alias("notification_type"), F.lit("IMPORTANT").alias("severity"),
        F.concat(F.lit("MANUAL_REVIEW_REQUIRED:"), F.col("listing_id")).alias("deduplication_key"))


def fresh(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    return candidates.join(stored.select("deduplication_key"), "deduplication_key", "left_anti")


def deferred(at: Column, preference: Preference) -> Column:
    """True in a digest mode or inside the quiet hours, which may cross midnight."""
    if preference.digest_mode != "IMMEDIATE":
        return F.lit(True)
    if not preference.quiet_start or not preference.quiet_end:
        return F.lit(False)
    clock = F.date_format(at, "HH:mm:ss")
    start, end = (value if len(value) == 8 else value + ":00" for value in (preference.quiet_start, preference.quiet_end))
    return ((clock >= start) & (clock < end)) if start < end else ((clock >= start) | (clock < end))


def digest(alerts: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """Alerts per tumbling window; the same expression serves a watermarked stream."""
    return alerts.groupBy(F.window(F.col(at), width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("alerts"))


def counters(notifications: DataFrame) -> DataFrame:
    """Visible, unread, read and dismissed notifications."""
    return notifications.agg(
        F.count_if(~F.col("dismissed")).alias("visible"), F.count_if(~F.col("dismissed") & ~F.col("read")).alias("unread"),
        F.count_if("read").alias("read"), F.count_if("dismissed").alias("dismissed"))


def apply_state(notifications: DataFrame, updates: DataFrame) -> DataFrame:
    """Set read or dismissed by id; ``updates`` has notification_id, read, dismissed."""
    changes = updates.groupBy("notification_id").agg(F.bool_or("read").alias("new_read"), F.bool_or("dismissed").alias("new_dismissed"))
    return notifications.join(changes, "notification_id", "left").withColumn("read", F.coalesce("new_read", "read")).withColumn(
        "dismissed", F.coalesce("new_dismissed", "dismissed")).drop("new_read", "new_dismissed")
