"""Repeated byte strings against a dictionary of all of them."""

import collections
import hashlib
import random

import pytest

from lumenmart.llm import suffix_levels
from tests.llm.test_tokens_dedup import frame


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def check(spark, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    rows = suffix_levels.without_repeats(frame(spark, texts, ids).repartition(7), **options).collect()
    expected = sorted([(i, *b) for i, b in zip(ids, brute(texts, 200), strict=True)], key=repr)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows], key=repr) == expected
    return rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared, line = words(rng, 80), words(rng, 45)
    near = words(rng, 150)
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "w" * 1500, "ab" * 700, words(rng, 400), shared, near, near, near]
    out += [words(rng, 60) + " " + shared + " " + words(rng, 60) for _ in range(6)]
    out += [words(rng, 10) + line + words(rng, 10) + line for _ in range(6)]
    for _ in range(10):
        parts = near.split()
        for _ in range(rng.randrange(1, 5)):
            parts[rng.randrange(len(parts))] = "edit" + str(rng.random())
        out.append(" ".join(parts))
    return out


def test_against_all_strings(spark, texts):
    check(spark, texts)


def test_repeated_rows_and_missing_ids(spark, texts):
    check(spark, texts + texts[8:14], [None, 5, 5, *range(10, 10 + len(texts) + 3)])


def test_crowded_entries_go_string_by_string(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_levels, "TOGETHER", 2)
    check(spark, texts)


def test_chunk_borders_change_nothing(spark, texts, monkeypatch):
    from lumenmart.llm.suffix_levels import picked_places
    import numpy as np

    data = "".join(t or "" for t in texts).encode()
    array, ends = np.frombuffer(data, np.uint8), np.array([len(data)])
    whole = [np.concatenate(c) for c in zip(*picked_places(array, ends))]
    monkeypatch.setattr(suffix_levels, "CHUNK", 333)
    cut = [np.concatenate(c) for c in zip(*picked_places(array, ends))]
    cover = lambda x: sorted((int(s), int(p)) for p, a, z in zip(x[1], x[2], x[3]) for s in range(a, z + 1))
    assert cover(whole) == cover(cut)


def test_small_table_and_kept_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = [r.text for r in docs.collect()]
    rows = check(spark, texts, keep_bytes=True)
    for r in rows:
        text = texts[r.doc_id].encode()
        gone = b"".join(text[s.start : s.end] for s in r.spans)
        assert len(gone) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_no_documents(spark):
    assert suffix_levels.without_repeats(frame(spark, [])).count() == 0
