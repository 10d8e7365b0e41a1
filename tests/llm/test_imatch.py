"""I-Match fingerprints: exact edits, likeness near the true share of common terms."""

import hashlib
import random

import numpy as np
import pytest

from lumenmart.llm import imatch, queries
from lumenmart.llm.common import plain

SCHEMA = "doc_id long, text string, range int, copy boolean, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "f") for r in rows], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def check(spark, rows):
    """Edits by brute force; returns the result rows in the order of the documents."""
    rows = ordered(rows)
    got = imatch.compared(frame(spark, rows)).collect()
    want = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert imatch.likeness(r.fingerprint, r.edited_fingerprint) == pytest.approx(r.near_edited)
    return got


def words_of(rng, n, size):
    return " ".join(f"{rng.choice('xyz')}{int(rng.paretovariate(0.6)) % size}é" for _ in range(n))


def test_edits_odd_rows_and_equal_texts(spark):
    rng = random.Random(2)
    rows = [(n * 7, rng.choice((None, "", " ", "é🙂x", "same text here again", words_of(rng, rng.randrange(1, 300), 4000)))) for n in range(200)]
    rows += [(7, "tie"), (7, "tie"), (14, None), (None, "no id"), (None, "no id"), (None, None), (-5, "a" * 90_000)]
    got = check(spark, rows)
    by_text = {}
    for r, fingerprint in {(r.doc_id, r.n_chars, r.fingerprint): r.fingerprint for r in got}.items():
        by_text.setdefault(r[:2], set()).add(fingerprint)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault((doc_id, len(text or "")), text or "")
    equal = {}
    for key, found in by_text.items():
        assert len(found) == 1
        equal.setdefault(texts[key], set()).update(found)
    assert all(len(found) == 1 for found in equal.values())


def test_single_row_follows_itself_and_empty_table(spark):
    (row,) = check(spark, [(3, "abcdefgh")])
    assert row.near_next == 1.0
    assert imatch.compared(frame(spark, [])).count() == 0
    assert [r.doc_id for r in check(spark, [(None, "x"), (None, None)])] == [None, None]


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    terms = set(imatch.lexicon(plain(docs)).tolist())
    count = {}
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for _, text in texts:
        for word in set(text.encode().split()):
            count[word] = count.get(word, 0) + 1
    pairs = sum(count.values())
    most = min(imatch.MOST_IDF, np.log(imatch.MOST_TERMS * len(texts) / pairs))
    assert terms == {imatch.term_hash(w) for w, n in count.items() if imatch.LEAST_IDF <= np.log(len(texts) / n) <= most}
    got = {r.doc_id: r for r in queries.op13_imatch(spark, folder).collect()}
    gaps = []
    for k, (doc_id, text) in enumerate(texts):
        after = imatch.edited(text, texts[(k + 1) % len(texts)][1])
        one, two = ({w for w in set(t.encode().split()) if imatch.term_hash(w) in terms} for t in (text, after))
        if len(one | two) > 20:
            gaps.append(got[doc_id].near_edited - len(one & two) / len(one | two))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.1
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.98


def test_plain_fingerprints(spark):
    rows = [(1, "b a c"), (2, "c b  a\n"), (3, "a b d"), (4, None), (5, "")]
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]
    assert imatch.likeness(got[1], got[2]) == 1.0
