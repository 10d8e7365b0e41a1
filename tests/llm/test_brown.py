"""Class model: base score by hand, probabilities that add up, held-out gain, odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmart.llm import brown
from tests.llm.test_tokens_dedup import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), ""]


def base(texts, ids):
    counts = collections.Counter()
    for text, i in zip(texts, ids, strict=True):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, [(len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for t in texts]


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(0)
    out = []
    for i in range(120):
        pool = [f"{'ab'[i % 2]}{k}" for k in range(30)]
        out.append(" ".join(rng.choice(pool, 60)) + f" Once{i} ÉA\x0bx\x1cy")
    return out + [None, "", "  ", "new words ONLY", "a1 " * 4000]


@pytest.mark.parametrize("vocabulary,most", [(1000, 50), (40, 20), (5, 3)])
def test_base_and_counts(spark, docs, vocabulary, most):
    ids = [*range(len(docs) - 2), None, 3]
    rows = brown.scored_documents(frame(spark, docs + docs[:2], [*ids, 0, 1]).repartition(4), vocabulary=vocabulary, most=most, k=4).collect()
    n, expected = base(docs + docs[:2], [*ids, 0, 1])
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert got == sorted((a, b, round(c, 6)) for a, b, c in expected)
    assert all(r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0 for r in rows)


@pytest.mark.parametrize("vocabulary", [1000, 25])
def test_probabilities_add_up(spark, docs, vocabulary):
    train = frame(spark, docs)
    model = brown.fit(train.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vocabulary=vocabulary, most=20, k=4)
    known = [bytes(r.word).decode() for r in model.counts.collect()]
    for before in ("a1", "b2", "never-seen"):
        ask = [before] + [f"{before} {w}" for w in known if w] + [f"{before} unheard-of"]
        rows = {r.doc_id: r.score for r in brown.score(frame(spark, ask).select("doc_id", "text"), model).collect()}
        ids = model.head.value
        step = lambda w: 10 ** model.transition[model.classes[ids.number.get(w.encode(), ids.rare)], model.classes[ids.end]]
        first = 10 ** rows[0] / step(before)
        total = sum(10 ** rows[i] / first / step(t.partition(" ")[2]) for i, t in enumerate(ask) if i) + step(before)
        assert abs(total - 1) < 1e-6


def test_exchange_finds_the_two_languages(spark, docs):
    rng = np.random.default_rng(1)
    pairs = np.zeros((40, 40))
    for i in range(40):
        for j in range(40):
            pairs[i, j] = rng.integers(5, 9) if i % 2 == j % 2 else 0
    classes = brown.exchange(pairs, 2)
    assert len(set(classes[::2])) == 1 and len(set(classes[1::2])) == 1 and classes[0] != classes[1]


def test_held_out_texts_score_better_than_the_base(spark):
    rows = brown.scored_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_no_rows_and_no_training_rows(spark):
    assert brown.scored_documents(frame(spark, [])).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = brown.scored_documents(frame(spark, ["a b", "", None], only_held)).collect()
    assert [(r.train_tokens, r.n_known) for r in rows] == [(0, 0)] * 3 and all(math.isfinite(r.score) for r in rows)
