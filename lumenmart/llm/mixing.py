"""Mixing sources to target weights by blocks of words.

Every source is a stream of words (its documents in a keyed order) cut into blocks of fixed length.
Targets come from the weights; a source at its limit passes its excess on. Slots of the output are
filled shard by shard: a multinomial draw says how many slots of a shard each source gets, the chance
following what is still due, so that all draws together meet every target. The j-th slot of a source
takes block perm(j mod blocks), with another pseudorandom permutation in each pass over the source,
hence no block is used more often than there are passes.

The driver holds one row of numbers, the slots of each source. Tasks split it level by level, each time
into at most `FAN_OUT` ranges of shards, until a range is one shard; every draw is seeded by its range.
Start offsets come from running totals over bounded chunks of documents, in two levels, so a source with
a third of all rows is split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumenmart.llm.common import WORD, fold, spread, stage, tune, whole_row
from lumenmart.llm.feistel import permute

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Ranges into which a range of shards is split at a time.
FAN_OUT = 32
RANGES_PER_TASK = 16
CHUNK_ROWS = 4096
#: Chunks whose totals are added up together.
CHUNKS_TOGETHER = 4096
MOST_TASKS = 4096
#: A table of sources up to this many rows is broadcast.
FEW_SOURCES = 100_000
SEED = 20_240_607


def targets(sizes: np.ndarray, weights=WEIGHTS, most: int = MOST_PASSES) -> np.ndarray:
    """Share of the total per source (in source order): by weight, none above `most` times its size."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    out, free, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while free.any():
        share = left * weight / weight[free].sum()
        full = free & (share > most * sizes)
        if not full.any():
            out[free] = share[free]
            break
        out[full] = most * sizes[full]
        left -= float(out[full].sum())
        free &= ~full
    return out


def drawn(due: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `slots` slots by what is due to each source, never more than that."""
    counts = np.zeros(len(due), dtype=np.int64)
    while slots:
        rest = due - counts
        more = np.minimum(rng.multinomial(slots, rest / rest.sum()), rest)
        counts += more
        slots -= int(more.sum())
    return counts


@dataclass
class Mixture:
    """`sources`: number, source, source_size, target, blocks, slots. `placed`: documents with their start in the
    source's stream. `slots`: shard, position, source_no, block. `copies`: how often each block is taken."""

    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    copies: DataFrame
    block_words: int


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= FEW_SOURCES else frame


def _placed(sized: DataFrame) -> DataFrame:
    """Running total of the sizes inside each source: inside chunks, over the totals of a batch of chunks, over batches."""
    chunks = max(1, sized.count() // CHUNK_ROWS)
    rows = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(chunks)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "text_key", "size")
    totals = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("total")).withColumn("batch", F.floor(F.col("chunk") / CHUNKS_TOGETHER))
    before = lambda keys, order: F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    batches = totals.groupBy("source_no", "batch").agg(F.sum("total").alias("total")).select("source_no", "batch", before(["source_no"], "batch").alias("earlier"))
    bases = totals.withColumn("base", before(["source_no", "batch"], "chunk")).join(batches, ["source_no", "batch"]).select(
        "source_no", "chunk", (F.col("base") + F.col("earlier")).alias("base"))
    return (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(bases, ["source_no", "chunk"])
        .select("doc_id", "text_key", "source", "source_no", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("start"))
    )


def _split(shards_in_child: int, shard_slots: int, seed: int):
    """Split ranges of shards: first shard, slots of each source, and how many of its slots earlier ranges took."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first, counts, done in zip(part["first"], part["counts"], part["done"], strict=True):
                due, at, first = np.array(counts, dtype=np.int64), np.array(done, dtype=np.int64), int(first)
                rng = np.random.default_rng([seed, shards_in_child, first])
                while left := int(due.sum()):
                    counts = drawn(due, min(shards_in_child * shard_slots, left), rng)
                    yield pd.DataFrame({"first": [first], "counts": [counts.tolist()], "done": [at.tolist()]})
                    due, at, first = due - counts, at + counts, first + shards_in_child

    return run


def _slots(spark, quota: np.ndarray, blocks: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """Slots of all shards: tasks draw the ranges of shards down to single shards, then each shard's blocks and their order."""
    ranges = "first long, counts array<long>, done array<long>"
    shards = -(-int(quota.sum()) // shard_slots)
    frame = spark.createDataFrame([(0, quota.tolist(), [0] * len(quota))] if shards else [], ranges)
    size = 1
    while size < shards:
        size *= FAN_OUT
    while size > 1:
        size //= FAN_OUT
        tasks = -(-shards // (size * RANGES_PER_TASK))
        frame = frame.mapInPandas(_split(size, shard_slots, seed), ranges).repartition(min(tasks, MOST_TASKS), "first")
    blocks_of = blocks.tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, counts, done in zip(part["first"], part["counts"], part["done"], strict=True):
                chosen = []
                for number in np.flatnonzero(counts):
                    slot, many = int(done[number]) + np.arange(int(counts[number])), blocks_of[number]
                    for turn in np.unique(slot // many):
                        index = permute(slot[slot // many == turn] % many, many, (seed * 1_000_003 + int(number)) * 31 + int(turn))
                        chosen.append((np.full(len(index), number), index))
                numbers, index = (np.concatenate(c) for c in zip(*chosen, strict=True))
                order = np.random.default_rng([seed, 0, int(shard)]).permutation(len(index))
                yield pd.DataFrame({"shard": int(shard), "position": np.arange(len(index)), "source_no": numbers[order], "block": index[order]})

    return frame.mapInPandas(run, "shard long, position long, source_no long, block long")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mixture:
    """Plan the mixture of rows with doc_id, text and source. The same rows give the same mixture.

    Null texts have no words. A null source is a source of its own, after all others. Repeated rows and
    null ids are documents like others. Sources without words, and an empty table, have no target.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    sized = stage(spread(rows).select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("text_key")))
    found = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = np.array([r["size"] for r in found], dtype=np.int64)
    goal = targets(sizes, weights, most)
    blocks = -(-sizes // block_words)
    quota = np.array([min(most * b, round(g * b / s)) if s else 0 for g, b, s in zip(goal.tolist(), blocks.tolist(), sizes.tolist(), strict=True)], dtype=np.int64)
    sources = spark.createDataFrame(
        [(i, r.source, int(s), float(g), int(b), int(q)) for i, (r, s, g, b, q) in enumerate(zip(found, sizes, goal, blocks, quota, strict=True))],
        "source_no long, source string, source_size long, target double, blocks long, slots long",
    )
    numbered = fold(sized, _small(sources.select("source_no", "source"), len(found)), ["source"], "inner")
    slots = stage(_slots(spark, quota, blocks, shard_slots, seed))
    copies = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("copies"))
    return Mixture(_small(sources, len(found)), stage(_placed(numbered)), slots, copies, block_words)


def _parts(mixture: Mixture) -> DataFrame:
    """Every overlap of a document with a block: word range inside the document."""
    width = F.lit(mixture.block_words)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
    parts = mixture.placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("block") * width, F.col("start")), F.least((F.col("block") + 1) * width, F.col("start") + F.col("size"))
    return parts.select("*", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"))


def _pieces(mixture: Mixture) -> DataFrame:
    """The same overlaps with the number of copies taken."""
    return _parts(mixture).join(mixture.copies, ["source_no", "block"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def joined_blocks(mixture: Mixture) -> DataFrame:
    """The mixture as places in documents: every slot joined by index with the document pieces of its block.

    Columns shard, position, source_no, block, doc_id, text_key, size, start and the word range low, high.
    """
    return mixture.slots.join(_parts(mixture).drop("source"), ["source_no", "block"])


def taken_words(mixture: Mixture) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted), source.

    Counted on the joined blocks. Where a document starts in its source's stream tells it from all others
    that have words; documents without words take none.
    """
    keys = ["source_no", "start"]
    words = joined_blocks(mixture).groupBy(*keys).agg(F.sum(F.col("high") - F.col("low")).alias("words"))
    placed = mixture.placed.select("doc_id", "size", *keys)
    found = placed.where("size > 0").join(words, keys, "left").unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return found.join(mixture.sources, "source_no").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source")


def _cut(text: str, words: list[tuple[int, int]], low: int, high: int) -> str:
    return text[words[low][0] : words[high - 1][1]]


_WORD = re.compile(WORD)


def cut_copies(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """Text of each copy: copy c holds the word ranges taken at least c times; a whole text stays as it is."""
    out, words = [], None
    for copy in range(1, max((c for _, _, c in pieces), default=0) + 1):
        runs: list[list[int]] = []
        for low, high, count in sorted(pieces):
            if count >= copy:
                if runs and runs[-1][1] == low:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
        if runs == [[0, max(h for _, h, _ in pieces)]]:
            out.append(text)
        else:
            words = words or [m.span() for m in _WORD.finditer(text)]
            out.append("\n".join(_cut(text, words, low, high) for low, high in runs))
    return out


def mixed_documents(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The mixture as documents, with the columns of `docs`: one row per document and copy, cut to the words taken.

    n_chars, where present, is that of the new text. Documents without a taken word have no row.
    """
    keys = ["_id", "_text", "_from"]
    named = [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_key").alias("_text"),
        F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).alias("_from"),
    ]
    lists = (
        _pieces(mixture).select("start", "low", "high", "copies", *named).groupBy(*keys, "start").agg(F.collect_list(F.struct("low", "high", "copies")).alias("pieces"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "pieces"))).alias("_lists"))
    )
    # the input row travels as one column, so none of its names meets those used here
    mine = docs.select(whole_row(docs), "doc_id", "source", F.col("text").alias("body"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    keyed = mine.select("row", "body", *named)
    turn = Window.partitionBy(*keys).orderBy(F.lit(1))
    chosen = keyed.join(lists, keys).withColumn("_pieces", F.col("_lists")[F.row_number().over(turn) - 1]["pieces"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([cut_copies(t, [(p["low"], p["high"], p["copies"]) for p in ps]) for t, ps in zip(text, pieces, strict=True)])

    out = chosen.select("row", F.explode(cut("body", "_pieces")).alias("cut"))
    changed = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return out.select(changed.alias("row")).select("row.*")


def mixed_blocks(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The output shards: shard, position, source_no, block, text of the block (its document pieces in stream order)."""
    @F.pandas_udf("string")
    def slice_(text: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, [m.span() for m in _WORD.finditer(t)], lo, hi) for t, lo, hi in zip(text, low, high, strict=True)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    pieces = _pieces(mixture).where("copies > 0")
    bodies = (
        fold(pieces, texts, ["doc_id", "text_key"], "inner")
        .select("source_no", "block", F.struct((F.col("start") + F.col("low")).alias("at"), slice_("text", "low", "high").alias("text")).alias("piece"))
        .groupBy("source_no", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        .select("source_no", "block", F.concat_ws("\n", "pieces.text").alias("text"))
    )
    return mixture.slots.join(bodies, ["source_no", "block"]).select("shard", "position", "source_no", "block", "text")
