"""The whole run: faults, relevance, redaction, merge; and the same as a stream over shuffled files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenmart.operators import ingest
from lumenmart.plans import run_queries
from lumenmart.streaming import jobs

FIELDS = "source_id string, external_id string, url string, title string, description string, price string, currency string, source_country string, segment string, condition string, detected_at string"


@pytest.fixture(scope="module")
def parts(spark):
    catalog = spark.createDataFrame(
        [(f"prod{i}", "brandx", f"model{i}", "", "Lens", "none") for i in range(3)], "product_id string, brand string, model string, version string, category string, native_mount string")
    watches = spark.createDataFrame(
        [("w", None, "zzqq7", [], None, "EUR", True)], "watch_id string, product_id string, query string, source_ids array<string>, max_price double, currency string, active boolean")
    return (
        spark.createDataFrame(run_queries.SOURCES, run_queries.SOURCE_SCHEMA), catalog,
        spark.createDataFrame([], "product_id string, alias string"), watches)


def record(number, **fields):
    row = {"source_id": "S1", "external_id": str(number), "url": f"https://a/{number}", "title": "Offer prod1", "description": "plain", "price": "10",
           "currency": "", "source_country": "", "segment": "NEW", "condition": "", "detected_at": "2001-01-01"} | fields
    return tuple(row[name.split()[0]] for name in FIELDS.split(", "))


RECORDS = [
    record(1, description="shutter count: 500, write to a@b.it"), record(2, title=""), record(3, price="x"), record(4, title="zzqq7 rare"), record(5, title="zzqq8 common"),
    record(6, title="zzqq8 common", source_id="S0"), record(7, source_id="S9"), record(1, price="12", detected_at="2001-02-01"), record(8, detected_at="soon"),
]


def test_one_run(spark, parts):
    done = ingest.run(spark.createDataFrame(RECORDS, FIELDS), *parts, None, F.lit("2001-06-30").cast("timestamp"))
    live = {r.duplicate_key: r for r in done.live.collect()}
    assert set(live) == {"S1:1", "S1:4", "S0:6"}
    assert live["S1:1"].price == 12.0 and str(live["S1:1"].first_seen_at) == "2001-01-01 00:00:00" and live["S1:1"].product_id == "prod1"
    assert sorted(r.problem for r in done.errors.collect()) == ["date is not ISO", "price is not a number", "title and address are required"]
    counted = ingest.counters(done, None, "r").first()
    assert (counted.raw, counted.normalized, counted.relevant, counted.ignored, counted.errors, counted.new, counted.updated) == (8, 5, 4, 1, 3, 3, 0)


def test_stream_equals_batch_on_shuffled_files(spark, parts, tmp_path):
    order = random.Random(3).sample(RECORDS, len(RECORDS))
    for at in (0, 5):
        spark.createDataFrame(order[at:at + 5], FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = jobs.read_feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], FIELDS).schema, files_per_batch=1)
    now = F.lit("2001-06-30").cast("timestamp")
    jobs.ingest_stream(feed, *parts, str(tmp_path / "out"), str(tmp_path / "cp"), now)
    batch = ingest.run(spark.createDataFrame(RECORDS, FIELDS), *parts, None, now).live
    columns = [c for c in batch.columns]
    streamed = jobs.live_table(spark, str(tmp_path / "out")).select(*columns)
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))


def test_repeated_texts_are_recognized_and_read_once(spark, parts, monkeypatch):
    read = []
    analyze = ingest.facts.analyze
    monkeypatch.setattr(ingest.facts, "analyze", lambda rows, as_of: read.append(rows.count()) or analyze(rows, as_of))
    repeated = [record(n, description="shutter count: 5000") for n in range(20, 26)] + [record(30, title="ab", description="c", source_id="S0"), record(31, title="a", description="bc", source_id="S0")]
    done = ingest.run(spark.createDataFrame(repeated, FIELDS), *parts, None, F.lit("2001-06-30").cast("timestamp"))
    assert read == [3]  # distinct texts, not records
    assert sorted((r.external_id, r.title, r.shutter_count) for r in done.live.collect()) == sorted(
        [(str(n), "Offer prod1", 5000) for n in range(20, 26)] + [("30", "ab", None), ("31", "a", None)])
