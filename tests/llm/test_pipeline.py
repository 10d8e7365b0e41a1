"""The pipeline, stage by stage, against brute force on its own input."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from lumenmart.llm import stages, toxicity
from lumenmart.llm.common import scratch
from lumenmart.llm.mixing import targets
from lumenmart.llm.queries import vocabulary_path
from tests.llm.test_chosen_path import brute

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, docs.collect(), after.columns, after.collect()))
        docs = after
    return out


def test_names_and_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    assert all(s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:-1])


def test_toxicity(spark, steps):
    _, docs, before, _, after = steps[0]
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in keep)


def test_exact_dedup(steps):
    _, _, before, _, after = steps[1]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    assert sorted(map(tuple, after)) == sorted(map(tuple, first.values()))


def test_near_dedup(steps):
    _, _, before, _, after = steps[2]
    classes = brute([r.text for r in before], [r.doc_id for r in before])
    keep = {c for _, c, _, _ in classes}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in keep)


def test_near_dedup_of_repeated_and_missing_ids(spark):
    """One row per class, whatever the ids: equal ids of unrelated texts, a copy beside a unique text, null ids."""
    text = lambda name, end="": " ".join(f"{name}{k}" for k in range(60)) + end
    rows = [
        (1, text("a"), "s"), (1, text("b"), "t"),
        (2, text("a", " more"), "a"), (2, text("c"), "z"),
        (None, text("d"), "s"), (None, text("d", " more"), "s"), (None, text("b", " more"), "s"), (None, text("e"), "s"),
        (3, "", "s"), (3, " ", "s"), (None, None, "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in stages.near_deduplicate(spark, docs, FOLDER).collect()]
    d = [r for r in got if r[0] is None and (r[1] or "").startswith("d0")]
    assert len(d) == 1 and d[0] in rows
    assert sorted(map(repr, (r for r in got if r not in d))) == sorted(map(repr, [rows[0], rows[1], rows[3], rows[7], rows[8], rows[9], rows[10]]))


def test_mixing(steps):
    _, _, before, _, after = steps[3]
    size, taken, texts = collections.Counter(), collections.Counter(), {r.doc_id: r for r in before}
    per_doc = collections.Counter()
    for r in before:
        size[r.source] += len(WORDS.findall(r.text))
    for r in after:
        words = len(WORDS.findall(r.text))
        taken[r.source] += words
        per_doc[r.doc_id] += words
        assert set(WORDS.findall(r.text)) <= set(WORDS.findall(texts[r.doc_id].text)) and r.n_chars == len(r.text) and r.source == texts[r.doc_id].source
    names = sorted(size)
    for name, goal in zip(names, targets(np.array([size[n] for n in names])), strict=True):
        assert abs(taken[name] - goal) <= 128 + 0.02 * goal
    assert all(n <= 3 * len(WORDS.findall(texts[i].text)) for i, n in per_doc.items())


def test_tokens(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    _, _, before, _, after = steps[4]
    expected = collections.Counter((r.doc_id, np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert collections.Counter((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in after) == expected


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one two three", None, None, 3), (2, "one two three", None, None, 3), (3, "w " * 20_000, "en", "b", 9)]
    for rows_ in (rows, []):
        docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() <= 3 * len(rows_)


CLASHING = ("text_key", "_key", "_digest", "_place", "_id", "_text", "_from", "_pieces", "_lists", "row", "name", "digest", "place", "score", "predicted", "cut", "body", "file", "_metadata", "a.b", "size")


def test_clashing_columns_pass_unchanged(spark):
    """Every stage but the last keeps columns of any name, with the values of their row."""
    rows = [(n, f"text {n} " + " ".join(f"w{n}x{k}" for k in range(30 + n)), "en", f"s{n % 3}", 0, *(f"{name}-{n}" for name in CLASHING)) for n in range(12)]
    rows += [(50 + n, rows[n][1], "en", "s0", 0, *(f"{name}-{50 + n}" for name in CLASHING)) for n in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING], name
    path = scratch(spark, "clash")
    docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).write.parquet(path)
    after = spark.read.parquet(path).collect()
    assert {r[0] for r in after} <= set(range(12)) and after
    for r in after:
        assert list(r[5:]) == [f"{name}-{r[0]}" for name in CLASHING]
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame([(1, "only text")], "doc_id long, text string"), FOLDER)
    assert last.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and last.count() == 1
