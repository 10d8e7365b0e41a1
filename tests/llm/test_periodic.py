"""Periodic runs against a scan of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from lumenmart.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_runs string, runs int, start string"


def all_runs(words):
    """Every maximal run, period by period; of the periods of one stretch the smallest."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted(((a, n, q) for (a, n), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def fibonacci(steps):
    a, b = "a", "ab"
    for _ in range(steps):
        a, b = b, b + a
    return list(b)


def found(words):
    return [tuple(r) for r in periodic.runs_of(np.unique(words, return_inverse=True)[1].astype(np.int64), np.arange(len(words))).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 15)), min_size=1, max_size=6))
def test_runs_of_repeated_pieces(pieces):
    words = list("".join(piece * times for piece, times in pieces))
    assert found(words) == all_runs(words)


def test_runs_of_hard_strings():
    rng = random.Random(3)
    cases = [fibonacci(12), list("aab" * 30 + "a" + "aab" * 30), list("a" * 300), list(("ab" * 9 + "c") * 9), list("abcdefghijkl" * 2), list("abcabcabcabc"), list("abcdef" * 2), list("abcdef" * 2)[:-1]]
    cases += [[rng.choice("ab") for _ in range(rng.randrange(400))] for _ in range(60)]
    for words in cases:
        assert found(words) == all_runs(words)


def test_table_and_odd_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a " * 40, "x\x85y " * 14, "a\x1cb " * 13, "né " * 12, " ".join(fibonacci(9)), "word " * 70_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(90))) for _ in range(80)]
    texts += [" ".join((["u", "v", "w", str(n)] * 30)[: rng.randrange(100)]) for n in range(80)]
    rows = [(n, t, "x", 1, "y") for n, t in enumerate(texts)] + [(3, "one", "x", 1, "y"), (None, "b " * 30, None, None, None)]
    got = [tuple(r) for r in periodic.digests(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    want = [expected(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 100_000]
    long = [r for r in got if r[0] == 9]
    assert sorted((r for r in got if r[0] != 9), key=key) == sorted((w for w in want if w[0] != 9), key=key)
    assert long[0][1:6] == (1, 0, 70_000, 1, 70_000_000)
    assert periodic.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert got.pop(r.doc_id) == expected(r.doc_id, r.text)
    assert not got


def test_general_interface_gives_runs_and_text(spark):
    frame = spark.createDataFrame([(10, "go " + "la di " * 6 + "end")], "key long, body string")
    row = periodic.word_runs(frame, "key", "body", whole=True).first()
    assert [tuple(r) for r in row.runs] == [(1, 12, 2)] and row.collapsed == "go la di end"
