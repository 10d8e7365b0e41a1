from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenmart.operators import health, listings, memory, notify, serve
from lumenmart.sources import scans, sinks
from lumenmart.streaming import jobs, stateful
from tests import builders
from tests.builders import day

START = datetime(2026, 1, 1)


def random_checks(count=600, seed=5):
    rng = random.Random(seed)
    rows, at = [], START
    for number in range(count):
        at += timedelta(minutes=rng.choice([1, 5, 30, 200]))
        source = "hot" if number % 3 == 0 else f"s{rng.randint(0, 3)}"
        status = rng.choice(["FAILED", "FAILED", "HEALTHY", "DEGRADED"])
        kind = None if status == "HEALTHY" else rng.choice(["timeout", "network"])
        rows.append((number, source, at, status, rng.randint(0, 2), kind, None if kind is None else rng.randint(1, 3)))
    return rows


CHECK = "check_id bigint, source_id string, checked_at timestamp, status string, result_count int, error_type string, severity_rank int"


def test_streaks_match_a_sequential_scan(spark):
    rows = random_checks()
    found = {r.check_id: r for r in health.streaks(spark.createDataFrame(rows, CHECK).select("check_id", "source_id", "checked_at", "status", "result_count")).collect()}
    state = {}
    for number, source, at, status, results, _, _ in rows:
        streak, success, previous, last = state.get(source, (0, None, None, None))
        expected = (0 if status != "FAILED" else streak + 1, at if status != "FAILED" else success)
        row = found[number]
        assert (row.consecutive_failures, row.last_success_at, row.previous_status, row.previous_result_count) == (*expected, previous, last)
        state[source] = (*expected, status, results)


def scan_incidents(rows):
    state, numbers = {}, {}
    for number, source, _, _, _, kind, rank in rows:
        open_kind, open_rank, count = state.get(source, (None, 0, 0))
        if kind is None:
            state[source] = (None, 0, count)
            continue
        if open_kind != kind or rank > open_rank:
            count += 1
            open_rank = rank
        state[source] = (kind, open_rank, count)
        numbers[number] = count
    return numbers


def test_incidents_match_a_sequential_scan(spark):
    rows = random_checks(seed=9)
    found = health.incidents(spark.createDataFrame(rows, CHECK)).collect()
    assert {r.check_id: r.incident_no for r in found} == scan_incidents(rows)


def test_incident_stream_equals_batch(spark, tmp_path):
    rows = random_checks(seed=12)
    for name, order in (("in-order", rows), ("newest-first", rows[::-1]), ("shuffled", random.Random(5).sample(rows, len(rows)))):
        folder = tmp_path / name
        for part in range(4):
            spark.createDataFrame(order[part * 150:(part + 1) * 150], CHECK).coalesce(1).write.mode("append").parquet(str(folder / "feed"))
        feed = jobs.read_feed(spark, str(folder / "feed"), spark.createDataFrame([], CHECK).schema, files_per_batch=1)
        jobs.incident_stream(feed, str(folder / "out"), str(folder / "state"), str(folder / "cp"))
        assert {r.check_id: r.incident_no for r in jobs.incident_log(spark, str(folder / "out")).collect()} == scan_incidents(rows)


def test_digest_stream_counts_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(START + timedelta(minutes=rng.randint(0, 60 * 24 * 30)), rng.choice("ab")) for _ in range(300)]
    schema = "at timestamp, kind string"
    for part in range(3):
        spark.createDataFrame(sorted(rows, reverse=True)[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = jobs.read_feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    jobs.write_digest(feed, str(tmp_path / "log"), str(tmp_path / "cp"), "at", "1 day", "kind")
    streamed = {tuple(r) for r in jobs.digest_totals(spark, str(tmp_path / "log"), "kind").collect()}
    batch = notify.digest(spark.createDataFrame(rows, schema), "at", "1 day", "kind").select("window.start", "kind", "alerts")
    assert streamed == {tuple(r) for r in batch.collect()} and sum(r[2] for r in streamed) == 300


def test_degradation_rules(spark):
    rows = [(1, "a", 5, 10, 0, False), (2, "a", 0, 10, 0, False), (3, "a", 0, 10, 0, False), (1, "b", 5, 10, 0, False), (2, "b", 0, 10, 0, False),
            (1, "c", 5, 500, 0, False), (2, "c", 5, 1, 2, False), (3, "c", 5, 1, 0, True)]
    metrics = spark.createDataFrame(rows, "run_no int, source_id string, relevant int, response_time_ms int, errors int, source_failed boolean")
    watched = spark.createDataFrame([("a",), ("a",)], "source_id string")
    got = {(r.source_id, r.run_no): (r.status, r.rule) for r in health.degraded(metrics, 300, watched).collect()}
    healthy = ("HEALTHY", None)
    assert got == {
        ("a", 1): healthy, ("a", 2): ("DEGRADED", "nothing relevant any more"), ("a", 3): healthy, ("b", 1): healthy, ("b", 2): healthy,
        ("c", 1): ("DEGRADED", "response over timeout"), ("c", 2): ("DEGRADED", "record errors"), ("c", 3): ("FAILED", None)}


def test_upsert_stream_equals_batch_over_several_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 30)}", str(i), START + timedelta(minutes=rng.randint(0, 10_000)), i, float(i)) for i in range(400)]
    schema = "duplicate_key string, record_id string, seen_at timestamp, event_id bigint, price double"
    frame = spark.createDataFrame(rows, schema)
    for part in range(4):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = jobs.read_feed(spark, str(tmp_path / "feed"), frame.schema, files_per_batch=1)
    jobs.write_changes(jobs.upsert_stream(feed), str(tmp_path / "log"), str(tmp_path / "cp"))
    streamed = {tuple(r) for r in jobs.current(spark, str(tmp_path / "log"), ["duplicate_key"]).select("duplicate_key", "listing_id", "price").collect()}
    batch = listings.collapse(frame, "seen_at", "event_id").selectExpr("duplicate_key", "cast(first_record as string) as listing_id", "price")
    assert streamed == {tuple(r) for r in batch.collect()}


def test_alert_stream_drops_repeats(spark, tmp_path):
    schema = "deduplication_key string, created_at timestamp"
    for rows in ([("k1", START), ("k1", START + timedelta(minutes=1)), ("k2", START)], [("k1", START + timedelta(days=900)), ("k3", START)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = jobs.read_feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    stateful.write_fresh_alerts(feed, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.deduplication_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k1", "k2", "k3"]


def test_normalize_defaults_errors_and_keys(spark):
    sources = spark.createDataFrame([("s1", "Shop", "JSON_FEED", "IT", "EUR", "USED")], "source_id string, name string, source_type string, country string, currency string, segment string")
    fields = "source_id string, external_id string, url string, title string, description string, price string, currency string, source_country string, segment string, condition string, detected_at string"
    records = spark.createDataFrame([
        ("s1", "7", "https://a.it/1", " Sony ", "d", "12.5", "", "", "NEW", "", ""), ("s1", "", "HTTPS://A.it/2", "x", None, None, "USD", None, None, None, "2026-01-02T03:04:05Z"),
        ("s1", "9", "", "no url", "", "", "", "", "", "", ""), ("s1", "10", "https://a", "bad price", "", "abc", "", "", "", "", "")], fields)
    good, bad = listings.normalize(records, sources, F.lit("2026-08-01").cast("timestamp"))
    rows = {r.duplicate_key: r for r in good.collect()}
    assert set(rows) == {"s1:7", "url:https://a.it/2"} and rows["s1:7"].segment == "NEW" and rows["s1:7"].currency == "EUR" and rows["s1:7"].title == "Sony"
    assert rows["url:https://a.it/2"].detected_at == datetime(2026, 1, 2, 3, 4, 5) and bad.count() == 2
    assert all(r.raw_record_reference.startswith("sha256:") for r in rows.values())


def test_upsert_keeps_first_id_and_late_batches_lose(spark):
    schema = "duplicate_key string, listing_id string, first_seen_at timestamp, last_seen_at timestamp, price double"
    stored = spark.createDataFrame([("a", "1", START, START + timedelta(days=5), 10.0)], schema)
    batch = spark.createDataFrame([("a", "2", START + timedelta(days=9), START + timedelta(days=9), 8.0), ("b", "3", START, START, 1.0)], schema)
    rows = {r.duplicate_key: r for r in listings.upsert(stored, batch).collect()}
    assert rows["a"].listing_id == "1" and rows["a"].price == 8.0 and rows["a"].first_seen_at == START and len(rows) == 2
    late = spark.createDataFrame([("a", "4", START, START + timedelta(days=1), 99.0)], schema)
    assert listings.upsert(stored, late).first().price == 10.0


def test_watch_pairs_and_alerts(spark):
    frame = builders.listings(spark, {"product_id": "p", "title": "Sony A7 IV", "price": 900.0}, {"product_id": "q", "title": "Red gear", "price": 50.0, "source": "other"})
    schema = "watch_id string, product_id string, query string, source_ids array<string>, max_price double, currency string, active boolean"
    watches = spark.createDataFrame([
        ("w1", "p", None, [], 1000.0, "EUR", True), ("w2", "p", None, [], 5.0, "EUR", True), ("w3", None, "GEAR", ["s"], None, "EUR", True),
        ("w4", None, "gear", [], None, "EUR", True), ("w5", "q", None, [], 1.0, "EUR", False)], schema)
    pairs = listings.watch_pairs(frame, watches, F.col("title"))
    assert sorted((r.listing_id, r.watch.watch_id) for r in pairs.collect()) == [("l0", "w1"), ("l0", "w2"), ("l1", "w4")]
    live = frame.withColumn("active", F.lit(True)).withColumn("warnings", F.array().cast("array<string>"))
    kinds = {(r.listing_id, r.notification_type) for r in notify.listing_alerts(live, pairs).collect()}
    assert kinds == {("l0", "NEW_MATCH"), ("l0", "PRICE_BELOW_TARGET"), ("l1", "NEW_MATCH")}


def test_quiet_hours_cross_midnight(spark):
    rows = spark.createDataFrame([(START.replace(hour=h),) for h in (23, 3, 12)], "at timestamp")
    quiet = notify.Preference(quiet_start="22:00", quiet_end="07:00")
    assert [r[0] for r in rows.select(notify.deferred(F.col("at"), quiet)).collect()] == [True, True, False]
    assert rows.select(notify.deferred(F.col("at"), notify.Preference(digest_mode="HOURLY"))).first()[0] is True


def test_focal_classes_and_close_purchased(spark):
    rows = spark.createDataFrame([("24-70mm f/2.8", True), ("50mm", False), ("50mm", True), ("16-35 mm", True), ("A7", False)], "m string, z boolean")
    assert [r[0] for r in rows.select(memory.focal_classes(F.col("m"), F.col("z"))).collect()] == [["STANDARD", "TELEPHOTO"], ["STANDARD"], None, ["ULTRA_WIDE", "STANDARD"], None]
    wishes = spark.createDataFrame([("1", "p", "EITHER", "ACTIVE", None), ("2", "p", "NEW", "ACTIVE", None), ("3", "p", "USED", "PAUSED", None)], "w string, product_id string, condition_preference string, status string, updated_at date")
    bought = spark.createDataFrame([("p", "USED"), ("p", None)], "product_id string, condition_at_purchase string")
    assert [r.status for r in memory.close_purchased(wishes, bought, F.lit("2026-01-01").cast("date")).orderBy("w").collect()] == ["PURCHASED", "ACTIVE", "PAUSED"]


def test_sort_keeps_missing_last_both_ways(spark):
    rows = spark.createDataFrame([("a", 2000), ("b", None), ("c", 2010), ("d", None), ("e", 2010)], "product_id string, release_year int").withColumns(
        {"brand": F.lit("x"), "model": F.lit("m"), "version": F.lit("")})
    ids = lambda descending: [r.product_id for r in serve.sort_products(rows, "newest", descending).collect()]
    assert ids(False) == ["a", "c", "e", "b", "d"] and ids(True) == ["e", "c", "a", "b", "d"]


def test_manual_listings_and_user_tables(spark, tmp_path):
    file = tmp_path / "manual.csv"
    line = lambda number, url, active, price="10": f"{number},{url},Shop,T,D,{price},EUR,IT,USED,,{active}\n"
    file.write_text(",".join(scans.MANUAL_FIELDS) + "\n" + line("M1", "https://a.it/x?utm_source=1", "true") + line("m1", "https://a.it/x", "1")
                    + line("m2", "https://a.it/y", "false") + line("m3", "ftp://b", "true") + line("m4", "https://a.it/z", "true", "abc"))
    good, bad = scans.manual_listings(spark, str(file))
    assert [r.url for r in good.collect()] == ["https://a.it/x"] and bad.count() == 2
    items = spark.createDataFrame([("1", "p", day("2026-01-01"), 5.0, "EUR", None, None, 7, None, ["a", "b,c"], None, 'say "hi"', True)],
                                  "item_id string, product_id string, purchase_date date, purchase_price double, currency string, condition_at_purchase string, shutter_count_at_purchase int, "
                                  "current_shutter_count int, warranty_until date, accessories array<string>, serial_reference string, notes string, active boolean")
    sinks.save_user_table(items, scans.INVENTORY_FIELDS, str(tmp_path / "inventory"))
    back = scans.load_inventory(spark, str(tmp_path / "inventory")).first()
    assert back.accessories == ["a", "b,c"] and back.active is True and back.notes == 'say "hi"' and back.purchase_date == day("2026-01-01")


def test_json_feed_isolates_non_objects(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.json").write_text(json.dumps({"data": {"items": [{"id": 1, "p": {"v": 2.5}}, "oops", {"id": 3}]}}))
    records, errors = scans.json_feed(spark, str(tmp_path / "f"), {"list_path": "data.items", "external_id": "id", "price": "p.v"})
    assert [(r.reference, r.external_id, r.price) for r in records.collect()] == [("record:1", "1", "2.5"), ("record:3", "3", None)] and errors.first().reference == "record:2"


def test_atom_href_wins(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><link href="https://a.it/1"/><title>T</title><summary>S</summary><updated>2026</updated></entry></feed>')
    row = scans.rss_feed(spark, str(tmp_path / "a.xml"), row_tag="entry").first()
    assert (row.external_id, row.url, row.title, row.description) == ("i", "https://a.it/1", "T", "S")


def test_sources_config(spark, tmp_path):
    source = {"source_id": "s", "name": "n", "source_type": "RSS_FEED", "endpoint": "e", "enabled": True, "country": "IT", "currency": "EUR", "segment": "USED",
              "request_timeout_seconds": 15, "retry_count": 1, "minimum_request_interval_seconds": 3600, "mapping": {"price_regex": "x"}, "notes": ""}
    (tmp_path / "s.json").write_text(json.dumps({"sources": [source]}))
    from lumenmart.operators import contracts
    found = contracts.violations(scans.load_sources(spark, str(tmp_path / "s.json")), "sources", F.col("source_id"), contracts.source_config())
    assert [(r.field, r.rule, r.value) for r in found.collect()] == [("mapping", "unknown mapping key", "price_regex")]


def test_source_type_and_price_format_rules(spark):
    from lumenmart.operators import contracts
    schema = "source_id string, source_type string, segment string, country string, currency string, mapping map<string,string>, price_extraction map<string,string>"
    good = {"currency_symbol": "€", "currency_code": "EUR", "decimal_separator": ",", "thousands_separator": "."}
    rows = spark.createDataFrame([
        ("a", "JSON_FEED", "NEW", "IT", "EUR", {}, good), ("b", "FTP", "NEW", "IT", "EUR", {}, None), ("c", None, "OLD", "it", "EU", {}, {"regex": "x" * 21, **good}),
        ("d", "RSS_FEED", "USED", "IT", "EUR", {}, {"currency_code": "EUR"})], schema)
    found = contracts.violations(rows, "sources", F.col("source_id"), [*contracts.source_config(), *contracts.price_format()])
    assert sorted((r.row_key, r.field, r.rule) for r in found.collect()) == [
        ("b", "source_type", "domain"), ("c", "country", "two capitals"), ("c", "currency", "three capitals"), ("c", "price_extraction", "part over 20 characters"),
        ("c", "price_extraction", "unknown price key"), ("c", "segment", "domain"), ("c", "source_type", "domain"), ("d", "price_extraction", "missing price key")]


def test_price_alerts_join_the_observations_once(spark):
    from lumenmart.plans import ingest_queries
    from lumenmart.plans.registry import Tables

    alerts = ingest_queries.price_alerts(Tables(spark, "/root/testdata/sf0.001"))
    # what is left to run reads staged tables, not the given ones
    assert not any("testdata" in path for path in alerts.inputFiles())
    assert alerts.select("deduplication_key").distinct().count() == alerts.count() > 0
