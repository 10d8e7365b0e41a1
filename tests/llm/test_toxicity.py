"""Toxicity scores: held-out accuracy, edge cases, what may not enter a score."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenmart.llm import toxicity


@pytest.fixture(scope="module")
def table(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def scored(table):
    docs, labels = table
    return toxicity.scored_documents(docs, labels).toPandas(), labels.toPandas()


def test_held_out_accuracy(scored):
    rows, labels = scored
    both = rows[rows.held_out].merge(labels, on="doc_id")
    positive, negative = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    assert (positive[:, None] > negative[None, :]).mean() >= 0.9
    assert (both[both.predicted == 1].toxic == 1).mean() >= 0.95 and both[both.toxic == 1].predicted.mean() >= 0.75


def test_rows_and_flags(scored, table):
    rows, _ = scored
    assert len(rows) == table[0].count() and rows.score.between(0, 1).all()
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))


def test_only_training_texts_and_labels_count(spark, table):
    docs, labels = table
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = toxicity.fit(docs, labels), toxicity.fit(docs.withColumn("lang", F.lit("x")), changed)
    assert first == second


def test_odd_rows(spark, table):
    docs, labels = table
    model = toxicity.fit(docs, labels)
    rows = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, " \n", "c"), (2, "idiot moron " * 3, "d"), (2, "idiot moron " * 3, "d"), (3, "word " * 50_000, "e")], "doc_id long, text string, score string")
    got = toxicity.score(rows, model).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert [r.predicted for r in sorted(got, key=lambda r: (r.doc_id or 0))] == [0, 0, 0, 1, 1, 0]
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_without_labels(spark, table):
    docs, labels = table
    none = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert set(toxicity.scored_documents(docs.limit(5), none).toPandas().score) == {0.0}


def test_features():
    assert toxicity.features(np.array([], dtype=int), 3) == [0.0] * 5
    assert toxicity.features(np.array([4, 1, 5]), 4)[:3] == [5.0, 4.0, 1.0]
    assert toxicity.features(np.array([2]), 4)[:3] == [2.0, 0.0, 0.0]


def _short(spark, header=""):
    """Short messages of distinct texts: every third one abuses somebody."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        words = [f"w{n}" for n in rng.integers(0, 400, 6)]
        if i % 3 == 0:
            words[2:2] = ["idiot", "moron"]
        rows.append((i, header + " ".join(words), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.mark.parametrize("header", ["", "a header that every text of one busy source begins with: "])
def test_short_texts_and_common_headers_train_the_dictionaries(spark, header):
    docs = _short(spark, header)
    assert toxicity._distinct(docs.select("text", F.col("toxic").alias("label"))).count() == docs.select("text", "toxic").distinct().count()
    rows = toxicity.scored_documents(docs, docs).join(docs, "doc_id").where("held_out").collect()
    assert all(r.predicted == r.toxic for r in rows) and {r.toxic for r in rows} == {0, 1}


def test_copies_count_once_per_label(spark):
    rows = spark.createDataFrame([("A  b", 0), ("a b\n", 0), ("a b", 1), ("", 0), ("", 1), ("c", 1)], "text string, label int")
    assert sorted((r.label, r.text.lower().split()) for r in toxicity._distinct(rows).collect()) == [(0, []), (0, ["a", "b"]), (1, []), (1, ["a", "b"]), (1, ["c"])]
