"""Similar texts against all pairs."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from lumenmart.llm import chosen_path
from tests.llm.test_tokens_dedup import frame


def grams(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute(texts, ids):
    sets = [grams(t) for t in texts]
    distinct = [s for s in dict.fromkeys(sets) if s]
    links = {s: [t for t in distinct if t != s and 5 * len(s & t) >= 4 * len(s | t)] for s in distinct}
    root = {}
    for s in distinct:
        if s not in root:
            todo, root[s] = [s], s
            while todo:
                for t in links[todo.pop()]:
                    if t not in root:
                        root[t] = s
                        todo.append(t)
    least, copies = {}, collections.Counter(sets)
    for s, i in zip(sets, ids, strict=True):
        if s and i is not None:
            least[root[s]] = min(i, least.get(root[s], i))
    return sorted(((i, least.get(root[s]), len(links[s]), copies[s]) if s else (i, i, 0, 1) for s, i in zip(sets, ids, strict=True)), key=repr)


def got(spark, texts, ids, **options):
    rows = chosen_path.similar_classes(frame(spark, texts, ids).repartition(5), **options).collect()
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    out = [None, "", " \n", "one", "one  two", "one two", "one two three four five", "one two three four  five", "a b c d e f", "x" * 4000]
    passage = [word() for _ in range(60)]
    for _ in range(4):
        chain = [word() for _ in range(rng.choice((40, 130, 300)))]
        for _ in range(40):
            chain = list(chain)
            for _ in range(rng.randrange(0, 3)):
                chain[rng.randrange(len(chain))] = word()
            out.append(rng.choice((" ", "\n")).join(chain))
    out += [" ".join([word() for _ in range(50)] + passage + [word() for _ in range(50)]) for _ in range(40)]
    return out + out[20:30] + [" ".join(word() for _ in range(200)) for _ in range(60)]


@pytest.mark.parametrize("small,depth", [(1024, 3), (16, 3), (8, 0)])
def test_against_all_pairs(spark, texts, small, depth):
    ids = [None, 4, 4, *range(10, 7 + len(texts))]
    assert got(spark, texts, ids, small=small, depth=depth) == brute(texts, ids)


def test_a_table_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    texts, ids = [r.text for r in rows], [r.doc_id for r in rows]
    assert got(spark, texts, ids) == brute(texts, ids)


def test_shingles_follow_words():
    texts = ["a b c d e f g", " a\tb c d\x0be f  g ", "a b c d e f", "ab c d e f g", "", "é b", "b é", "a b c d e f g h i j k"]
    sets = list(chosen_path.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [3, 3, 2, 2, 0, 1, 1, 7]
    assert (sets[0] == sets[1]).all() and set(sets[2].tolist()) < set(sets[0].tolist()) < set(sets[7].tolist()) and sets[5] != sets[6]


def test_sketches_estimate_similarity():
    rng, functions = np.random.default_rng(0), chosen_path._functions()
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    other = np.concatenate((base[:444], rng.integers(0, 1 << 63, 56, dtype=np.uint64)))
    same = np.mean([(chosen_path.sketch(base + np.uint64(k), functions) == chosen_path.sketch(other + np.uint64(k), functions)).mean() for k in range(40)])
    assert abs(same - 444 / 556) < 0.04


def test_runs_reach_the_recall():
    assert chosen_path.runs_needed() == 5 and chosen_path.runs_needed(recall=0.9) == 1


def test_no_documents(spark):
    assert got(spark, [], []) == [] and got(spark, ["", None], [3, None]) == brute(["", None], [3, None])
