"""Archives: exact round trips, revisit rules, magic inside payloads, pointer jumping."""

import collections
import hashlib
import random

import pytest

from lumenmart.llm import warc
from lumenmart.llm.common import scratch
from lumenmart.llm.files import write_file

SCHEMA = "page_id long, url string, html string, digest string, original long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def brute(rows):
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        for place, i in enumerate(order):
            revisit = place > 0 and len(payload) >= 100
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", order[0] if revisit else None))
    return sorted(out, key=repr)


def got(frame):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    fake = warc.record(99, "http://fake", b"inner " * 30, "0" * 64, None, False).decode()
    bodies = ["".join(rng.choice("ab<é日>\r\n") for _ in range(rng.randrange(300))) for _ in range(60)]
    bodies += ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, fake * 3, "WARC/1.0\r\n" * 50, fake + "z" * 300_000, "WARC/1.1\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n" * 9]
    out = [(i, f"http://h/{i}", b) for i, b in enumerate(bodies)]
    return out + [(None, None, "n" * 200), (None, "u", "n" * 200), (3, "dup", "q" * 150), (3, "dup", "q" * 150), (-4, "a b\r\nX: y", "q" * 150)]


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, rows, packed):
    folder = scratch(spark, "warc")
    files = warc.write_archives(pages(spark, rows).repartition(3), folder, packed, roll=40_000)
    for span in (warc.RANGE, 5_000):
        assert got(warc.read_archives(files, packed, span)) == brute(rows)
    assert all(r.sound for r in warc.read_archives(files, packed).collect())


def test_false_starts_are_candidates_but_not_records(spark, rows):
    files = warc.write_archives(pages(spark, rows), scratch(spark, "warc"), packed=False)
    assert warc.candidates(files, packed=False).count() > len(rows)


def test_members_in_stored_payloads_are_rejected(spark):
    inner = warc._packed(warc.record(7, "u", b"inside", "0" * 64, None, False))
    outer = warc.record(1, "u", inner * 3, hashlib.sha256(inner * 3).hexdigest(), None, False)
    import zlib

    machine = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = machine.compress(outer) + machine.flush()
    path = scratch(spark, "warc") + "/a.warc.gz"
    write_file(path, data + data)
    files = spark.createDataFrame([(path, 2 * len(data))], "path string, size long")
    assert warc.candidates(files).count() == 8
    assert [r.page_id for r in warc.read_archives(files).collect()] == [1, 1]


@pytest.mark.parametrize("packed", [True, False])
def test_long_headers(spark, packed):
    """Headers beyond the first look; the records after them are read too."""
    long = [(i, "http://h/" + "é" * n, f"body {i}") for i, n in enumerate((10, 40_000, 200_000, 10, 70_000))]
    files = warc.write_archives(pages(spark, long).coalesce(1), scratch(spark, "warc"), packed)
    for span in (warc.RANGE, 5_000):
        assert got(warc.read_archives(files, packed, span)) == brute(long)


def test_pointer_jumping(spark):
    chain = [(p, i, i + 1) for p in (1, 2) for i in range(100)] + [(1, 1000, 50), (2, 500, 501)]
    links = spark.createDataFrame(chain, "file long, at long, to long")
    assert warc.reached(links).where("at < 100").count() == 200
    assert warc.reached(links).where("at >= 500").count() == 0


def test_no_pages(spark):
    assert warc.archive_round_trip(pages(spark, []), scratch(spark, "warc")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_damage_is_reported_not_skipped(spark, tmp_path, packed):
    rows = [(n, f"http://x/{n}", f"page {n} " * (20 + n)) for n in range(50)]
    files = warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "a"), packed).collect()
    (path, size), = [(r.path, r.size) for r in files]
    data = open(path, "rb").read()
    starts = sorted(r.at for r in warc.read_archives(spark.createDataFrame(files), packed).collect())
    hurt = starts[24]
    for name, broken, lost_from in (
        ("zeroed", data[: hurt + 4] + b"\0" * 20 + data[hurt + 24 :], hurt), ("cut", data[:-7], starts[-1]), ("headless", b"\0\0" + data[2:], 0), ("tail", data + b"\0" * 30, size),
    ):
        file = str(tmp_path / f"{name}.warc")
        open(file, "wb").write(broken)
        one = spark.createDataFrame([(file, len(broken))], "path string, size long")
        with pytest.raises(warc.DamagedArchive, match=f"byte {lost_from}, {len(broken) - lost_from} bytes"):
            warc.read_archives(one, packed)
        got = warc.read_archives(one, packed, damaged="report").collect()
        assert [(r.at, r.payload_bytes) for r in got if r.record_type == "damaged"] == [(lost_from, len(broken) - lost_from)]
        assert sorted(r.at for r in got if r.record_type != "damaged") == [s for s in starts if s < lost_from]
