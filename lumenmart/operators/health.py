"""Source health over time: streaks, transitions, incidents, runs.

A busy source may hold a large part of all checks, so no window ever spans a
whole source. Checks are cut into time slots; inside a slot ordinary windows run,
and only one summary row per slot is carried forward along the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenmart.session import stage

SLOT_SECONDS = 3600
# Problem types and their severity rank.
SEVERITY_RANK = {"warning": 1, "error": 2, "critical": 3}
# Short labels of our own for what usually lies behind a problem type.
PROBABLE_CAUSE = {
    "authentication": "check the login", "timeout": "slow or unreachable source",
    "network": "connection lost", "malformed_data": "changed response format",
}
OTHER_CAUSE = "unknown"


def _slotted(checks: DataFrame, seconds: int) -> DataFrame:
    return checks.withColumn("slot", F.floor(F.unix_micros(F.col("checked_at").cast("timestamp")) / F.lit(seconds * 1_000_000)))


def latest(checks: DataFrame, name: str = "source_id") -> DataFrame:
    """Last check per source name, ignoring case."""
    return checks.groupBy(F.lower(name).alias("name_key")).agg(
        F.max_by(F.struct(*checks.columns), F.struct("checked_at", "check_id")).alias("row")).select("row.*")


def streaks(checks: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Add previous_status, consecutive_failures, last_success_at, previous_result_count.

    ``checks`` has check_id, source_id, checked_at, status, result_count.
    """
    rows = _slotted(checks, slot_seconds)
    ordered = Window.partitionBy("source_id", "slot").orderBy("checked_at", "check_id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    success = F.col("status") != "FAILED"
    rows = rows.withColumn("successes", F.sum(success.cast("int")).over(upto))
    since = Window.partitionBy("source_id", "slot", "successes").orderBy("checked_at", "check_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("local_streak", F.sum(F.when(success, 0).otherwise(1)).over(since))
        .withColumn("local_success", F.max(F.when(success, F.col("checked_at"))).over(upto))
        .withColumn("local_previous", F.lag("status").over(ordered))
        .withColumn("local_results", F.lag("result_count").over(ordered))
    )
    last = F.struct("checked_at", "check_id")
    slots = rows.groupBy("source_id", "slot").agg(
        F.max("successes").alias("successes"), F.max_by("local_streak", last).alias("trailing"),
        F.max("local_success").alias("slot_success"), F.max_by("status", last).alias("slot_status"),
        F.max_by("result_count", last).alias("slot_results"))
    along = Window.partitionBy("source_id").orderBy("slot")
    slots = slots.withColumn("block", F.sum((F.col("successes") > 0).cast("int")).over(along))
    in_block = Window.partitionBy("source_id", "block").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("carried", F.sum("trailing").over(in_block)).withColumn("success_so_far", F.max("slot_success").over(along))
    carry = slots.select(
        "source_id", "slot", F.lag("carried").over(along).alias("carry_streak"), F.lag("success_so_far").over(along).alias("carry_success"),
        F.lag("slot_status").over(along).alias("carry_status"), F.lag("slot_results").over(along).alias("carry_results"))
    joined = rows.join(carry, ["source_id", "slot"])
    first = F.col("local_previous").isNull()
    return (
        joined.withColumn("consecutive_failures", F.when(
            F.col("successes") == 0, F.col("local_streak") + F.coalesce("carry_streak", F.lit(0))).otherwise(F.col("local_streak")))
        .withColumn("last_success_at", F.coalesce("local_success", "carry_success"))
        .withColumn("previous_status", F.when(first, F.col("carry_status")).otherwise(F.col("local_previous")))
        .withColumn("previous_result_count", F.when(first, F.col("carry_results")).otherwise(F.col("local_results")))
        .select(*checks.columns, "consecutive_failures", "last_success_at", "previous_status", "previous_result_count")
    )


def quality_of_response(timeout_ms: int) -> Column:
    """Degradations a formally successful check still shows (after ``streaks``)."""
    ok = F.col("status") != "FAILED"
    return (
        F.when(ok & (F.col("result_count") == 0) & (F.col("previous_result_count") > 0), "empty_results")
        .when(ok & (F.col("response_time_ms") > 0.8 * timeout_ms), "slow_response")
    )


def incidents(problems: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Incident per run of one problem type; a rise in severity opens a new one.

    ``problems``: check_id, source_id, checked_at, status, error_type, severity_rank
    (null for healthy checks, which close whatever is open). Within one run an
    incident starts where severity exceeds everything seen before in the run.
    """
    return number_along(_starts(problems, slot_seconds).where("kind <> ''"), "starts", "incident_no")


def _starts(problems: DataFrame, slot_seconds: int) -> DataFrame:
    """All checks with ``starts``: whether an incident begins there."""
    rows = _slotted(problems, slot_seconds).withColumn("kind", F.coalesce("error_type", F.lit("")))
    ordered = Window.partitionBy("source_id", "slot").orderBy("checked_at", "check_id")
    breaks = F.coalesce(F.lag("kind").over(ordered) != F.col("kind"), F.lit(False))
    rows = rows.withColumn("piece", F.sum(breaks.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    in_piece = Window.partitionBy("source_id", "slot", "piece").orderBy("checked_at", "check_id")
    rows = rows.withColumn("local_top", F.max("severity_rank").over(in_piece.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.struct("checked_at", "check_id")
    slots = rows.groupBy("source_id", "slot").agg(
        F.max("piece").alias("pieces"), F.min_by("kind", last).alias("first_kind"), F.max_by("kind", last).alias("last_kind"),
        F.max_by(F.greatest(F.coalesce("local_top", F.lit(0)), F.coalesce("severity_rank", F.lit(0))), last).alias("last_top"))
    along = Window.partitionBy("source_id").orderBy("slot")
    continues = (F.col("pieces") == 0) & F.coalesce(F.lag("last_kind").over(along) == F.col("first_kind"), F.lit(False))
    slots = (
        slots.withColumn("continues", continues).withColumn("block", F.sum((~F.col("continues")).cast("int")).over(along)))
    in_block = Window.partitionBy("source_id", "block").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("top_so_far", F.max("last_top").over(in_block))
    carry = slots.select(
        "source_id", "slot", F.lag("last_kind").over(along).alias("carry_kind"), F.lag("top_so_far").over(along).alias("carry_top"))
    joined = rows.join(carry, ["source_id", "slot"])
    carried = (F.col("piece") == 0) & F.coalesce(F.col("carry_kind") == F.col("kind"), F.lit(False))
    before = F.greatest(F.coalesce("local_top", F.lit(0)), F.when(carried, F.col("carry_top")).otherwise(0))
    return joined.withColumn("starts", (F.col("kind") != "") & F.coalesce(F.col("severity_rank") > before, F.lit(False)))


def incident_lives(told: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Incidents with resolution and repair proposal.

    ``told``: as for ``incidents``, with ``covers`` (checks each row stands for) and ``failure`` (time and id of
    the last failed check among them, nulls: none). An incident is resolved by the first later row that is
    healthy or opens another incident; met by its number, so no window spans a source.
    """
    marked = _starts(told, slot_seconds).withColumn("ends", F.col("starts") | (F.col("kind") == ""))
    # read three times below
    numbered = stage(number_along(number_along(marked, "starts", "incident_no"), "ends", "end_no"))
    closing = numbered.where("ends").select("source_id", (F.col("end_no") - 1).alias("end_no"), F.col("checked_at").alias("resolved_at"))
    failed = F.when(F.col("failure.failed_at").isNotNull(), F.col("failure"))
    found = numbered.where("kind <> ''").groupBy("source_id", "incident_no").agg(
        F.min("checked_at").alias("occurred_at"), F.sum("covers").alias("checks"), F.min_by("error_type", F.struct("checked_at", "check_id")).alias("error_type"),
        F.min_by("severity_rank", F.struct("checked_at", "check_id")).alias("severity_rank"), F.min("end_no").alias("end_no"), F.max(failed).alias("failed"))
    latest_failure = found.groupBy("source_id").agg(F.max("failed").alias("latest"))
    cause = F.create_map(*[F.lit(part) for pair in PROBABLE_CAUSE.items() for part in pair])
    return found.join(closing, ["source_id", "end_no"], "left").join(latest_failure, "source_id").select(
        "source_id", "incident_no", "occurred_at", "checks", "error_type", "severity_rank", F.col("resolved_at").isNotNull().alias("resolved"), "resolved_at",
        F.coalesce(F.col("failed") == F.col("latest"), F.lit(False)).alias("latest_proposal"),
    ).withColumn("probable_cause", F.when(F.col("latest_proposal"), F.coalesce(F.try_element_at(cause, F.col("error_type")), F.lit(OTHER_CAUSE))))


def number_along(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Running count of ``flag`` per source in time order, carried slot by slot."""
    ordered = Window.partitionBy("source_id", "slot").orderBy("checked_at", "check_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("local_no", F.sum(F.col(flag).cast("int")).over(ordered))
    slots = rows.groupBy("source_id", "slot").agg(F.max("local_no").alias("n"))
    along = Window.partitionBy("source_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select("source_id", "slot", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("carry_no"))
    return rows.join(carry, ["source_id", "slot"]).withColumn(name, F.col("local_no") + F.col("carry_no")).drop("local_no", "carry_no")


def incident_summary(numbered: DataFrame) -> DataFrame:
    """One row per incident: first and last check, how many checks, repair proposal."""
    cause = F.create_map(*[F.lit(part) for pair in PROBABLE_CAUSE.items() for part in pair])
    return numbered.groupBy("source_id", "incident_no").agg(
        F.min("checked_at").alias("occurred_at"), F.max("checked_at").alias("last_seen_at"), F.count(F.lit(1)).alias("checks"),
        F.min_by("error_type", F.struct("checked_at", "check_id")).alias("error_type"),
        F.min_by("severity_rank", F.struct("checked_at", "check_id")).alias("severity_rank"),
        F.bool_or(F.col("status") == "FAILED").alias("repair_proposed"),
    ).withColumn("probable_cause", F.when(F.col("repair_proposed"), F.coalesce(F.try_element_at(cause, F.col("error_type")), F.lit(OTHER_CAUSE))))


def run_summary(records: DataFrame) -> DataFrame:
    """Counters and status per run over one row per (run, source, record outcome)."""
    per_source = source_metrics(records)
    return per_source.groupBy("run_id").agg(
        F.sum("raw").alias("raw"), F.sum("normalized").alias("normalized"), F.sum("relevant").alias("relevant"),
        F.sum(F.col("normalized") - F.col("relevant")).alias("ignored"), F.sum("errors").alias("errors"),
        F.count_if(~F.col("source_failed")).alias("sources_ok"), F.count_if("source_failed").alias("sources_failed"),
    ).withColumn("status", run_status(F.col("sources_ok"), F.col("sources_failed")))


def run_status(succeeded: Column, failed: Column) -> Column:
    return F.when(failed == 0, "COMPLETED").when(succeeded > 0, "PARTIAL").otherwise("FAILED")


def source_metrics(records: DataFrame) -> DataFrame:
    """Raw, normalized and relevant records and health per run and source.

    ``records``: run_id, source_id, normalized, relevant, error, source_failed (booleans).
    """
    out = records.groupBy("run_id", "source_id").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("normalized").alias("normalized"), F.count_if("relevant").alias("relevant"),
        F.count_if("error").alias("errors"), F.bool_or("source_failed").alias("source_failed"))
    return out.withColumn("status", F.when(F.col("source_failed"), "FAILED").when(F.col("errors") > 0, "DEGRADED").otherwise("HEALTHY"))


def degraded(metrics: DataFrame, timeout_ms: int, watched_sources: DataFrame) -> DataFrame:
    """Status of every run and source with all three rules of degradation, and the rule that holds.

    ``metrics``: run_no (consecutive per source), source_id, relevant, response_time_ms, errors, source_failed.
    A source degrades by record errors, by a response beyond the timeout, or when nothing is relevant now while
    something was in its previous run and an active watch covers it (``watched_sources``: source_id).
    """
    # the previous run is met by its number, so no window spans a source
    before = metrics.select("source_id", (F.col("run_no") + 1).alias("run_no"), F.col("relevant").alias("relevant_before"))
    covered = watched_sources.select("source_id").distinct().withColumn("covered", F.lit(True))
    rows = metrics.join(before, ["source_id", "run_no"], "left").join(covered, "source_id", "left")
    lost = (F.col("relevant") == 0) & F.coalesce(F.col("relevant_before") > 0, F.lit(False)) & F.coalesce("covered", F.lit(False))
    rule = (
        F.when(F.col("source_failed"), None).when(F.col("errors") > 0, "record errors")
        .when(F.col("response_time_ms") > timeout_ms, "response over timeout").when(lost, "nothing relevant any more")
    )
    return rows.withColumn("rule", rule).withColumn("status", F.when(F.col("source_failed"), "FAILED").when(F.col("rule").isNotNull(), "DEGRADED").otherwise("HEALTHY")).drop(
        "relevant_before", "covered")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), "started_at").alias("run")).select("run.*")


def recover_interrupted(runs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, errors): runs still marked as started are closed as failed."""
    hung = F.col("status") == "STARTED"
    errors = runs.where(hung).select("run_id", F.lit("recovery").alias("stage"), F.lit("interrupted_run").alias("error_type"), now.alias("occurred_at"))
    closed = runs.withColumn("finished_at", F.when(hung, now).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(hung, "FAILED").otherwise(F.col("status")))
    return closed, errors


def after_run(outcomes: DataFrame, fetches: DataFrame, previous: DataFrame, watched_sources: DataFrame, timeout_ms: int) -> DataFrame:
    """Health of every fetched source after a run, with the rule that degraded it and its failure streak.

    ``outcomes``: one row per record (source_id, normalized, relevant, error); ``fetches``: one row per source
    that was asked (source_id, source_failed, response_time_ms), also those that sent nothing; records of a
    failed fetch do not count. ``previous``: source_id, status, relevant, consecutive_failures as this
    function returned them for the run before.
    """
    counted = outcomes.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("normalized").alias("normalized"), F.count_if("relevant").alias("relevant"), F.count_if("error").alias("errors"))
    names = ("raw", "normalized", "relevant", "errors")
    now = fetches.select("source_id", "source_failed", "response_time_ms").join(counted, "source_id", "left").select(
        "source_id", "source_failed", "response_time_ms", F.lit(2).alias("run_no"),
        *[F.when(F.col("source_failed"), F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("long").alias(name) for name in names])
    before = previous.select("source_id", F.col("relevant").cast("long").alias("relevant"), F.lit(1).alias("run_no"))
    judged = degraded(now.unionByName(before, allowMissingColumns=True), timeout_ms, watched_sources).where("run_no = 2").drop("run_no")
    known = previous.select("source_id", F.col("status").alias("previous_status"), F.col("consecutive_failures").alias("streak_before"))
    return judged.join(known, "source_id", "left").withColumn(
        "consecutive_failures", F.when(F.col("source_failed"), F.coalesce("streak_before", F.lit(0)) + 1).otherwise(0)).drop("streak_before")


def run_after(sources: DataFrame, run_id: str, dry_run: bool = False) -> DataFrame:
    """The run's row from ``after_run``: counters and status; a run that asked no source is complete, a trial run says so."""
    ok, failed = F.count_if(~F.col("source_failed")), F.count_if("source_failed")
    totals = sources.agg(ok.alias("sources_ok"), failed.alias("sources_failed"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("raw", "normalized", "relevant", "errors")])
    status = F.lit("DRY_RUN") if dry_run else run_status(F.col("sources_ok"), F.col("sources_failed"))
    return totals.select(F.lit(run_id).alias("run_id"), status.alias("status"), "*")
