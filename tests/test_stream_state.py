"""Keyed tables and keyed stream state against plain folds over the same rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenmart.operators import health
from lumenmart.sources.keyed_table import KeyedTable
from lumenmart.streaming import jobs, stateful

START = datetime(2026, 1, 1)
CHECK = "check_id bigint, source_id string, checked_at timestamp, status string, error_type string, severity_rank int"


@pytest.fixture(autouse=True)
def two_partitions(spark):
    """Every partition of a stateful batch starts a Python worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(spark, folder, schema, *parts):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return jobs.read_feed(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_keyed_table_merges_runs_and_ignores_replays(spark, tmp_path):
    rng = random.Random(4)
    table = KeyedTable.of_changes(spark, str(tmp_path / "t"), ["k"])
    want = {}
    for number in range(21):
        rows = {rng.randrange(40): float(number) for _ in range(6)}
        want.update(rows)
        frame = spark.createDataFrame(list(rows.items()), "k long, v double")
        table.commit(frame, number)
        table.commit(spark.createDataFrame([(0, -1.0)], "k long, v double"), number)  # a replay is not taken twice
        assert len(table.runs()) <= 3 * 3
    assert {r.k: r.v for r in table.read().collect()} == want
    assert [run["level"] for run in table.runs()] == [2, 1, 0]
    # one older manifest stays readable, nothing else does
    assert len(list((tmp_path / "t" / "manifest").glob("*.json"))) == 2 and len(list((tmp_path / "t" / "runs").iterdir())) <= 6
    table.commit(table.read().where("k < 5").select("k", F.lit(7.0).alias("v")), 21)  # reads the path it writes
    assert {r.v for r in table.read().where("k < 5").collect()} <= {7.0}


def test_empty_keyed_table(spark, tmp_path):
    table = KeyedTable.of_changes(spark, str(tmp_path / "t"), ["k"])
    schema = spark.createDataFrame([], "k long, v double, batch long").schema
    assert table.read(schema).count() == 0
    with pytest.raises(ValueError):
        table.read()
    table.commit(spark.createDataFrame([], "k long, v double"), 0)
    assert table.read().count() == 0


def scan(rows):
    """Sequential lives of incidents and state of sources, as one process that sees all checks in order."""
    lives, state, latest = {}, {}, {}
    for check_id, source, at, status, kind, rank in sorted(rows, key=lambda r: (r[2], r[0])):
        source = source.lower()
        known = state.setdefault(source, {"streak": 0, "success": None, "checks": 0, "open": None, "count": 0})
        known["checks"] += 1
        known["status"] = status
        known["streak"] = known["streak"] + 1 if status == "FAILED" else 0
        known["success"] = known["success"] if status == "FAILED" else at
        open_ = lives.get((source, known["open"]))
        if kind is None or open_ is None or open_["kind"] != kind or rank > open_["rank"]:
            if open_ is not None:
                open_["resolved_at"] = at
            known["open"] = None
            if kind is None:
                continue
            known["count"] += 1
            known["open"] = known["count"]
            open_ = lives[source, known["open"]] = {"kind": kind, "rank": rank, "checks": 0, "at": at, "resolved_at": None}
        open_["checks"] += 1
        if status == "FAILED":
            latest[source] = known["open"]
    return lives, state, latest


def random_checks(n, seed):
    rng = random.Random(seed)
    rows = []
    for number in range(n):
        kind = rng.choice((None, None, "timeout", "timeout", "network", "other"))
        status = "HEALTHY" if kind is None else rng.choice(("FAILED", "DEGRADED"))
        name = rng.choice(("busy", "BUSY", "Busy", "rare", "odd"))
        rows.append((number, name, START + timedelta(minutes=rng.randrange(0, 600, 7)), status, kind, None if kind is None else rng.randrange(1, 4)))
    return rows


def test_slot_state_equals_sequential_scan_in_any_order(spark, tmp_path):
    rows = random_checks(240, 6)
    lives, state, latest = scan(rows)
    order = random.Random(1).sample(rows, len(rows))
    files(spark, str(tmp_path / "feed"), CHECK, order[:100], order[100:180], order[180:])
    table = stateful.run_slot_checks(stream(spark, str(tmp_path / "feed"), CHECK), str(tmp_path / "t"), str(tmp_path / "cp"), 7200)
    slots = table.read()
    got = {r.source_id: (r.status, r.consecutive_failures, r.last_success_at, r.checks) for r in stateful.source_state(slots).collect()}
    assert got == {s: (k["status"], k["streak"], k["success"], k["checks"]) for s, k in state.items()}
    found = {(r.source_id, r.incident_no): r for r in stateful.incident_lifecycle(slots).collect()}
    assert set(found) == set(lives)
    for key, life in lives.items():
        r = found[key]
        assert (r.error_type, r.severity_rank, r.checks, r.occurred_at, r.resolved_at, r.resolved) == (
            life["kind"], life["rank"], life["checks"], life["at"], life["resolved_at"], life["resolved_at"] is not None)
        assert r.latest_proposal == (latest.get(key[0]) == key[1])
        assert r.probable_cause == (health.PROBABLE_CAUSE.get(life["kind"], health.OTHER_CAUSE) if r.latest_proposal else None)


def test_expiry_by_timer_revival_and_late_rows(spark, tmp_path):
    schema = "duplicate_key string, seen_at timestamp"
    day = lambda n: START + timedelta(days=n)
    feed, log, path = (str(tmp_path / name) for name in ("feed", "log", "table"))

    def step(*rows):
        files(spark, feed, schema, list(rows))
        stateful.reduce_sightings(stream(spark, feed, schema), log, str(tmp_path / "cp1"))
        table = stateful.run_expiry(spark, log, path, str(tmp_path / "cp2"), 14)
        return {r.duplicate_key: (r.first_seen_at, r.last_seen_at, r.active) for r in stateful.listing_state(table).collect()}

    assert step(("a", day(0)), ("a", day(1)), ("b", day(3))) == {"a": (day(0), day(1), True), "b": (day(3), day(3), True)}
    # 14 days after its last sighting a is still active, a millisecond later it is not
    assert step(("c", day(15)))["a"][2] is True
    assert step(("c", day(15) + timedelta(milliseconds=1))) == {
        "a": (day(0), day(1), False), "b": (day(3), day(3), True), "c": (day(15), day(15) + timedelta(milliseconds=1), True)}
    # an old sighting is no sign of life, but the first one moves; a newer one revives
    rows = step(("a", day(-2)), ("d", day(0)), ("b", day(4)))
    assert rows["a"] == (day(-2), day(1), False) and rows["d"] == (day(0), day(0), False) and rows["b"][1:] == (day(4), True)
    rows = step(("a", day(20)))
    assert rows["a"] == (day(-2), day(20), True) and rows["b"][2] is False and rows["c"][2] is True


def test_sightings_are_rounded_to_milliseconds(spark, tmp_path):
    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    near = START + timedelta(seconds=7, microseconds=999_500)
    files(spark, feed, "duplicate_key string, seen_at timestamp", [("a", near), ("a", near - timedelta(microseconds=1)), ("b", near - timedelta(microseconds=1))])
    stateful.reduce_sightings(stream(spark, feed, "duplicate_key string, seen_at timestamp"), log, str(tmp_path / "cp"))
    rows = {r.duplicate_key: (r.first, r.last, r.clock) for r in spark.read.parquet(log).select(
        "duplicate_key", F.timestamp_millis("first_ms").alias("first"), F.timestamp_millis("last_ms").alias("last"), "clock").collect()}
    ms = lambda n: START + timedelta(milliseconds=n)
    assert rows == {"a": (ms(7999), ms(8000), ms(8000)), "b": (ms(7999), ms(7999), ms(8000))}


def summary_in_order(checks):
    """A slot's summary as one process that sees its checks in time order: (checks, last, last success, trailing failures, telling)."""
    telling, top, trailing, success = [], 0, 0, None
    for at, check_id, status, kind, rank in checks:
        if not telling or telling[-1][3] != kind or (kind and (rank or 0) > top):
            top = rank or 0
            telling.append([at, check_id, status, kind, rank, 0, None, None])
        telling[-1][5] += 1
        if status == "FAILED":
            telling[-1][6:] = [at, check_id]
            trailing += 1
        else:
            trailing, success = 0, at
    return (len(checks), *checks[-1][:3], success, trailing, [tuple(row) for row in telling])


def test_slot_summaries_without_python_workers(spark):
    rng = random.Random(9)
    rows = []
    for number in range(400):
        kind = rng.choice(("", "timeout", "timeout", "network"))
        status = None if number % 31 == 0 else "HEALTHY" if kind == "" else rng.choice(("FAILED", "DEGRADED"))
        rows.append((rng.choice("ab"), rng.randrange(9), rng.randrange(40), number, status, kind, rng.choice((None, 1, 2, 3))))
    rows += [("all", 0, n, 1000 + n, "FAILED", "timeout", 2) for n in range(3)]
    want = {}
    for source, slot, *check in rows:
        want.setdefault((source, slot), []).append(tuple(check))
    found = stateful.slot_summaries(spark.createDataFrame(rows, "source_id string, slot long, at long, check_id long, status string, kind string, severity_rank int"))
    got = {(r.source_id, r.slot): (r.checks, r.last_at, r.last_id, r.last_status, r.last_success_at, r.trailing_failures, [tuple(t) for t in r.telling]) for r in found.collect()}
    assert got == {key: summary_in_order(sorted(checks, key=lambda c: c[:2])) for key, checks in want.items()}
