"""Mixture invariants and target water level; neighbours against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmart.llm import mixing, permutation
from lumenmart.llm.feistel import permute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", 5) for i, t, s in rows], "doc_id long, text string, source string, copies string, start long")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, " ".join(f"w{i}_{k}" for k in range(rng.integers(0, 700))), f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    return out + [(None, "a b\tc", None), (None, None, None), (7, "", "s1"), (8, "x  y\x0bz", "tiny"), (8, "x  y\x0bz", "tiny"), (9, "é " * 4000, "ß")]


def test_targets():
    assert np.allclose(mixing.targets(np.array([100, 100, 100])), [50, 100, 150])
    assert np.allclose(mixing.targets(np.array([10, 1000, 0])), [30, 980, 0])
    got = mixing.targets(np.array([1, 1, 500, 500]))
    assert np.allclose(got, [3, 3, 996 * 3 / 4, 996 / 4]) and np.isclose(got.sum(), 1002)


def test_taken_words(spark, rows):
    docs = mixed_docs(spark, rows)
    plan = mixing.mix(docs.repartition(6), block_words=16, shard_slots=64)
    got = mixing.taken_words(plan).collect()
    sizes = {}
    for i, t, s in rows:
        sizes.setdefault(s, []).append(len(WORDS.findall(t or "")))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(WORDS.findall(t or ""))) for i, t, _ in rows)
    goal = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), mixing.targets(np.array([sum(sizes[s]) for s in sorted(sizes, key=lambda s: (s is None, s or ""))])), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sum(sizes[r.source]) and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 16 + 0.01 * goal[s], (s, taken[s], goal[s])
    again = mixing.taken_words(mixing.mix(docs.repartition(3), block_words=16, shard_slots=64)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixture_as_documents_and_blocks(spark, rows):
    docs = mixed_docs(spark, rows)
    plan = mixing.mix(docs, block_words=16, shard_slots=64)
    want = collections.Counter()
    for r in mixing.taken_words(plan).collect():
        want[r.doc_id] += r.taken
    out = mixing.mixed_documents(docs, plan)
    assert out.columns == docs.columns
    have = collections.Counter()
    source = collections.defaultdict(list)
    for i, t, _ in rows:
        source[i].append(WORDS.findall(t or ""))
    for r in out.collect():
        words = WORDS.findall(r.text)
        have[r.doc_id] += len(words)
        assert any(set(words) <= set(s) for s in source[r.doc_id])
    assert +have == +want
    blocks = mixing.mixed_blocks(docs, plan).collect()
    assert len(blocks) == plan.slots.count() and sum(len(WORDS.findall(b.text)) for b in blocks) == sum(want.values())
    assert max(len(WORDS.findall(b.text)) for b in blocks) == 16
    assert sorted((b.shard, b.position) for b in blocks) == [(k // 64, k % 64) for k in range(len(blocks))]


def test_many_sources_and_shards(spark):
    rows = [(i, "a b c d e f g " * (1 + i % 3), f"s{i % 1500}") for i in range(6000)]
    plan = mixing.mix(mixed_docs(spark, rows), block_words=2, shard_slots=32)
    slots = plan.slots.toPandas()
    quota = {r.source_no: r.slots for r in plan.sources.collect()}
    assert slots.groupby("source_no").size().to_dict() == {k: v for k, v in quota.items() if v}
    assert slots.shard.nunique() > mixing.FAN_OUT**2 / 2 and sorted(zip(slots.shard, slots.position, strict=True)) == [(k // 32, k % 32) for k in range(len(slots))]
    # a block returns only after all others of its source were taken as often
    uses = slots.groupby(["source_no", "block"]).size()
    blocks = {r.source_no: r.blocks for r in plan.sources.collect()}
    for number, used in uses.groupby("source_no"):
        assert used.max() - (used.min() if len(used) == blocks[number] else 0) <= 1
    by_source = collections.Counter()
    for r in mixing.taken_words(plan).collect():
        assert 0 <= r.taken <= 3 * r.size
        by_source[r.source] += r.taken
    goal = {r.source: r.target for r in plan.sources.collect()}
    assert all(abs(by_source[s] - goal[s]) <= 3 for s in goal)


def test_chunks_of_a_hot_source_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 3)
    monkeypatch.setattr(mixing, "CHUNKS_TOGETHER", 5)
    rows = [(i, "x " * (i % 7), "hot" if i % 3 else "other") for i in range(400)]
    placed = mixing.mix(mixed_docs(spark, rows), block_words=4, shard_slots=16).placed.where("size > 0").collect()
    for number in (0, 1):
        at = 0
        for start, size in sorted((r.start, r["size"]) for r in placed if r.source_no == number):
            assert start == at
            at += size
        assert at == sum(i % 7 for i in range(400) if (i % 3 == 0) == (number == 1))


def test_whole_copies_keep_their_text():
    assert mixing.cut_copies(" a  b c ", [(0, 2, 2), (2, 3, 1)]) == [" a  b c ", "a  b"]
    assert mixing.cut_copies("a b c", [(0, 1, 1), (1, 2, 0), (2, 3, 1)]) == ["a\nc"]


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "s"), (2, " ", None)]):
        assert [r.taken for r in mixing.taken_words(mixing.mix(mixed_docs(spark, rows))).collect()] == [0] * len(rows)


def test_permutations():
    for size in (1, 2, 3, 10, 257, 5000):
        images = permute(np.arange(size), size, 5)
        assert sorted(images.tolist()) == list(range(size))
    assert (permute(np.arange(1000), 1000, 5) != permute(np.arange(1000), 1000, 6)).mean() > 0.9


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")


def test_neighbours_of_a_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in permutation.nearest(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = frame.orderBy("vec_id").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    found = 0
    for query, hits in got.items():
        score = data @ data[ids == query][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:20]
        found += len({h[1] for h in hits} & set(ids[order]))
        assert [h[0] for h in hits] == list(range(1, 21)) and all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in hits)
        assert [h[1:] for h in hits] == sorted((h[1:] for h in hits), key=lambda h: (-h[1], h[0]))
    assert found / (20 * len(got)) >= 0.95


def test_ties_bad_vectors_and_lengths(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(60)] + [(100 + i, (rng.normal(size=3) * rng.integers(1, 9)).tolist()) for i in range(80)]
    bad = [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0]), (280, [None, 1.0, 1.0]), (300, [float("inf"), 0.0, 0.0]), (320, [1.0]), (None, [1.0, 1.0, 1.0])]
    got = permutation.nearest(vectors(spark, rows + bad), block=32, rerank=1.0).collect()
    asked = [i for i, _ in rows if i % 20 == 0]
    assert {r.query_id for r in got} == set(asked)
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    for q in asked:
        score = (data * data[ids == q][0]).sum(1)
        want = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert permutation.nearest(vectors(spark, bad)).count() == 0
    few = permutation.nearest(vectors(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.0]), (3, [2.0, 1.0])])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]


def test_recall_where_pivot_orders_tell_little(spark):
    """Wide vectors without structure, of unequal lengths: the fixed share held seven in ten of their neighbours."""
    rng = np.random.default_rng(7)
    data = (rng.normal(size=(2000, 256)) * rng.lognormal(0, 1, size=(2000, 1))).astype(np.float32).astype(float)
    got = collections.defaultdict(set)
    for r in permutation.nearest(vectors(spark, list(enumerate(data.tolist())))).collect():
        got[r.query_id].add(r.vec_id)
    found = 0
    for query in range(0, 2000, 20):
        order = np.lexsort((np.arange(2000), -(data @ data[query])))
        found += len(got[query] & set(order[order != query][:20].tolist()))
    assert found / (20 * 100) >= 0.95
