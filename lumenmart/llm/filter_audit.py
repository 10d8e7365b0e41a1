"""Filter interaction audit by contraction of contingency tensors.

Every document becomes five fail flags. Per part the counts of the 2^5 flag combinations form a tensor
of shape 2x2x2x2x2 (axis per filter, 0 pass, 1 fail). What any step of any order of the filters does is
one contraction of that tensor: along each axis it selects pass, fail or all. So the orders are never
replayed over documents; after the counts their cost depends on the number of parts only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.llm.common import BLANK, spread, tune

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
#: What a contraction keeps of an axis: pass, fail, all.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts contracted at once; each gives 600 rows.
PARTS_TOGETHER = 64


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: few words (A), repeated words (B), capitals (C), symbols (D)."""
    words = F.array_remove(F.split(text, BLANK), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < FEWEST_WORDS,
        "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, part, fails (the 5 flags as one number, A the highest bit), good, toxic.

    E holds where the same text (by SHA-256) has a smaller id anywhere in the table; rows without an id have
    no smaller one and are none, so they neither fail E nor make others fail. Text is read once and never
    shuffled: only flags, digest and id meet the labels and the first id of each text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = text_failures(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = spread(own).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        sum((flag.cast("int") * (16 >> place) for place, flag in enumerate(flags.values())), F.lit(0)).alias("fails"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # the key holds the id too, so a text that a third of the rows share is still spread over all tasks
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    joined = rows.join(known, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.select(
        "doc_id", "part", (F.col("fails") + repeats.cast("int")).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def contingency(rows: DataFrame) -> DataFrame:
    """One row per part: `cells`, at most 32 structs of flag number, documents, good and toxic ones."""
    counts = rows.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))


def contract(tensors: np.ndarray, axes: list[list[tuple[int, int]]]) -> np.ndarray:
    """Sums of 2x2x2x2x2 tensors (one per part): for every selector row, pass, fail or all along each axis."""
    chosen = np.array(axes, dtype=np.int64)
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *np.moveaxis(chosen, 1, 0), optimize="greedy")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(order) for order in itertools.permutations(filters)]


def audit_tensors(tensors: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of every part (rows), order and step (columns, steps within orders)."""
    after, here, failing, alone, filters = [], [], [], [], []
    for order in orders():
        done: set[str] = set()
        for name in order:
            before = [PASS if f in done else ALL for f in FILTERS]
            after.append([PASS if f == name else b for f, b in zip(FILTERS, before, strict=True)])
            here.append([FAIL if f == name else b for f, b in zip(FILTERS, before, strict=True)])
            failing.append([FAIL if f == name else ALL for f in FILTERS])
            alone.append([FAIL if f == name else PASS for f in FILTERS])
            filters.append(FILTERS.index(name))
            done.add(name)
    removed = contract(tensors, here)
    owner = np.array(filters)
    shared = np.stack([removed[:, owner == f].sum(1) for f in range(len(FILTERS))], 1)
    return {
        "kept": contract(tensors, after), "removed": removed, "redundant": contract(tensors, failing) - removed, "unique_fails": contract(tensors, alone),
        "good_lost": contract(good, here), "toxic_lost": contract(toxic, here), "shapley": shared[:, owner],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and the counts of `MEASURES`.

    `shapley` is the sum of what the step's filter removes over all orders; divided by 120 it is the
    filter's Shapley value. Null sources are the part of the empty string, null texts are empty; empty
    texts fail A only (and E as copies). Of several labels of an id, any 1 counts; repeated rows count
    once each. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    counted = contingency(failures(docs, labels))
    listed = np.repeat(np.array(orders()), len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), math.factorial(len(FILTERS)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for at in range(0, len(frame), PARTS_TOGETHER):
                some = frame.iloc[at : at + PARTS_TOGETHER]
                flat = np.zeros((3, len(some), 32), np.int64)
                for number, cells in enumerate(some["cells"]):
                    for cell in cells:
                        flat[:, number, cell["fails"]] = cell["n"], cell["good"], cell["toxic"]
                found = audit_tensors(*flat.reshape(3, len(some), 2, 2, 2, 2, 2))
                yield pd.DataFrame({
                    "part": np.repeat(some["part"].to_numpy(), len(steps)), "filter_order": np.tile(listed, len(some)), "step": np.tile(steps, len(some)),
                    **{name: found[name].ravel() for name in MEASURES},
                })

    return counted.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in MEASURES))
