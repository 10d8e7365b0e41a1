"""Filter audit against filters replayed in every order."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from lumenmart.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, fails string, first int, good int, toxic int"


def flags(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((doc_id, source or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > least[t]}))
    return out


def replayed(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    found, shapley = {}, Counter()
    every = flags(rows)
    for part in {p for _, p, _ in every}:
        own = [(i, f) for i, p, f in every if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                redundant = sum(f[name] for _, f in own) - len(gone)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                found[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, name] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in found.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "f", 1, 2, 3) for r in rows], SCHEMA)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_equals_replay(spark):
    rng = random.Random(11)
    pool = [None, "", " ", "few words", "CAPITALS here", "#", "a|b " * 210, "w " * 250, " ".join(map(str, range(300))), " ".join(map(str, range(99))) * 3, "Ünï " * 220]
    pool += [" ".join(rng.choice(("aa", "Bb", "c", "d%", str(n))) for _ in range(rng.choice((150, 260)))) for n in range(30)]
    rows = [(n, rng.choice(pool), rng.choice((None, "", "s1", "s2", "s'3"))) for n in range(300)]
    rows += [rows[5], rows[5], (None, "few words", "s1"), (None, None, None), (500, "only here", "s9")]
    labels = [(n, rng.choice((0, 1, None)), rng.choice((0, 1))) for n in range(0, 300, 2)] + [(2, 1, 0), (None, 1, 1), (9999, 1, 1)]
    merged = [(i, max((q or 0) for j, q, _ in labels if j == i), max(t for j, _, t in labels if j == i)) for i in {i for i, _, _ in labels if i is not None}]
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in filter_audit.audit(frame(spark, rows), labelled(spark, labels)).collect()}
    assert got == replayed(rows, merged)


def test_empty_tables(spark):
    assert filter_audit.audit(frame(spark, []), labelled(spark, [])).count() == 0
    rows = filter_audit.audit(frame(spark, [(1, None, None)]), labelled(spark, [])).collect()
    assert len(rows) == 600 and {(r.part, r.kept + r.removed) for r in rows if r.step == 1} == {("", 1)}


def test_contraction_selects_along_axes():
    tensors = np.arange(64, dtype=np.int64).reshape(2, 2, 2, 2, 2, 2)
    p, f, a = filter_audit.PASS, filter_audit.FAIL, filter_audit.ALL
    got = filter_audit.contract(tensors, [[f, p, a, a, p], [a, a, a, a, a]])
    assert got.tolist() == [[int(t[1, 0, :, :, 0].sum()), int(t.sum())] for t in tensors]
