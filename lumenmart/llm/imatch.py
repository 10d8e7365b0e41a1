"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency: neither the words of every text
nor those of very few. A fingerprint is the hash of a document's sorted distinct lexicon terms (the full
signature) and of their intersections with random subsets of the lexicon. Subsets come in `RATES`, each
rate with `SUBSETS` subsets, so that for short and for long documents some rate leaves about one term in
a subset; such hashes survive an edit that changes the full signature.

`likeness` reads two fingerprints alone: of the subsets of one rate, the share x in which both are empty
and the share y in which both agree estimate how many terms they have together and how many only one
has, hence 1 - ln y / ln x estimates the share of common terms.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenmart.llm.common import lean, plain, stage, tune

#: The band: terms in at most a tenth and at least one of 2,000 documents.
LEAST_IDF, MOST_IDF = math.log(10), math.log(2000)
#: With d distinct words in the mean document, at most d * exp(idf) terms have that idf or less; the band ends
#: earlier where this bound would pass 2^18, so the lexicon (8 bytes a term) never grows with the corpus.
MOST_TERMS = 1 << 18
RATES = (1 / 4, 1 / 16, 1 / 64, 1 / 256, 1 / 1024)
SUBSETS = 64
#: Subset hashes have 12 bits, written as three hexadecimal digits; empty subsets are written as dashes.
DIGITS, EMPTY = 3, "---"
#: Distinct terms that a task counts before it hands them on.
MEMORY = 200_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (64-bit hash), documents: over all rows, counted before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([term_hash(w) for w in counts], pa.int64()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return batch

        for part in parts:
            for text in part.column(0):
                for word in set(text.as_buffer().to_pybytes().split()):
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > MEMORY:
                    yield out()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("documents"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms in the idf band; at most `MOST_TERMS`."""
    counted = stage(document_frequencies(docs))
    pairs = counted.agg(F.sum("documents")).first()[0]
    size = docs.count()
    if not pairs:
        return np.zeros(0, np.int64)
    most = min(MOST_IDF, math.log(MOST_TERMS * size / pairs))
    idf = F.log(F.lit(float(size)) / F.col("documents"))
    # an only document is its own corpus: idf 0, no term is in the band
    found = counted.where((idf >= LEAST_IDF) & (idf <= most)).select("term").toArrow().column("term").to_numpy()
    return np.sort(found)


class Subsets:
    """The random subsets of a lexicon: for each term the numbers of the subsets that hold it."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.number = {int(term): at for at, term in enumerate(terms.tolist())}
        owners, subsets, steps = [], [], np.arange(1, len(RATES) * SUBSETS + 1, dtype=np.uint64)
        for rank, rate in enumerate(RATES):
            bound = np.uint64(int(rate * (1 << 64)) - 1)
            for subset in range(rank * SUBSETS, (rank + 1) * SUBSETS):
                inside = np.flatnonzero(_mixed(terms.view(np.uint64) + _STEP * steps[subset : subset + 1]) <= bound)
                owners.append(inside.astype(np.int32))
                subsets.append(np.full(len(inside), subset, np.int16))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.subsets = np.concatenate(subsets)[order]
        self.starts = np.searchsorted(owner[order], np.arange(len(terms) + 1))
        self.known: dict[bytes, int] = {}

    def numbers(self, words: set[bytes]) -> list[int]:
        """Lexicon places of words, sorted; words outside the lexicon are left out."""
        known, out = self.known, []
        for word in words:
            at = known.get(word)
            if at is None:
                if len(known) >= MEMORY:
                    known.clear()
                at = known[word] = self.number.get(term_hash(word), -1)
            if at >= 0:
                out.append(at)
        return sorted(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _STEP
    return values ^ (values >> np.uint64(32))


def signatures(texts: list[bytes], subsets: Subsets) -> tuple[list[str], np.ndarray]:
    """Full signature and subset hashes (-1: empty) of each text."""
    width = len(RATES) * SUBSETS
    full, owners, terms = [], [], []
    for at, text in enumerate(texts):
        words = set(text.split())
        numbers = subsets.numbers(words)
        # a text without lexicon terms still has a signature of its own: that of all its words
        content = subsets.terms[numbers].tobytes() if numbers else b" ".join(sorted(words))
        full.append(xxhash.xxh3_64_hexdigest(content))
        owners.append(np.full(len(numbers), at))
        terms.append(np.array(numbers, np.int64))
    out = np.full(len(texts) * width, -1, np.int32)
    owner, term = np.concatenate(owners), np.concatenate(terms)
    count = subsets.starts[term + 1] - subsets.starts[term] if len(term) else np.zeros(0, np.int64)
    if count.sum():
        begin = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(begin - subsets.starts[term], count)
        cell = np.repeat(owner, count) * width + subsets.subsets[place]
        hashes = np.repeat(_mixed(subsets.terms[term].view(np.uint64)), count)
        order = np.argsort(cell, kind="stable")  # terms stay sorted within a cell
        cell, hashes = cell[order], hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        rank = np.arange(len(cell)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(cell)]))))
        chained = _mixed(hashes + rank.astype(np.uint64) * _MIX)
        out[cell[starts]] = (_mixed(np.add.reduceat(chained, starts)) >> np.uint64(64 - 4 * DIGITS)).astype(np.int32)
    return full, out.reshape(len(texts), width)


def written(full: str, hashes: np.ndarray) -> str:
    return full + "".join([EMPTY if value < 0 else f"{value:03x}" for value in hashes.tolist()])


def parsed(fingerprint: str) -> tuple[str, np.ndarray]:
    head, rest = fingerprint[:16], fingerprint[16:]
    cells = [rest[at : at + DIGITS] for at in range(0, len(rest), DIGITS)]
    return head, np.array([-1 if cell == EMPTY else int(cell, 16) for cell in cells], np.int32)


def likenesses(full_one: list[str], one: np.ndarray, full_two: list[str], two: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) row by row: 1 for equal fingerprints, else the estimated share of common terms.

    The rate is the one whose share of subsets empty in both is nearest to a third.
    """
    shape = (len(one), len(RATES), SUBSETS)
    equal = (one == two).reshape(shape).sum(2)
    empty = ((one < 0) & (two < 0)).reshape(shape).sum(2)
    best = np.abs(empty - SUBSETS / 3).argmin(1)
    row = np.arange(len(one))
    x = np.clip(empty[row, best], 0.5, SUBSETS - 0.5) / SUBSETS
    y = np.clip(equal[row, best], 0.5, SUBSETS) / SUBSETS
    estimate = np.clip(1 - np.log(y) / np.log(x), 0.0, 1.0)
    nothing = empty.sum(1) == len(RATES) * SUBSETS
    same = (np.array(full_one) == np.array(full_two)) & (one == two).all(1)
    return np.where(same, 1.0, np.where(nothing, 0.0, estimate))


def likeness(one: str, two: str) -> float:
    """Likeness of two written fingerprints."""
    (head_one, cells_one), (head_two, cells_two) = parsed(one), parsed(two)
    return float(likenesses([head_one], cells_one[None], [head_two], cells_two[None])[0])


_SUBSETS: dict[int, Subsets] = {}


def _subsets_of(terms: np.ndarray) -> Subsets:
    """The subsets of a lexicon, made once per worker."""
    key = hash(terms.tobytes())
    if key not in _SUBSETS:
        _SUBSETS.clear()
        _SUBSETS[key] = Subsets(terms)
    return _SUBSETS[key]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint. The lexicon comes from the same rows.

    Null texts are empty; texts without lexicon terms are told apart by all their words. Equal texts have
    equal fingerprints. Null ids and repeated rows are rows like others; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    own = plain(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(own))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = _subsets_of(sent.value)
        for part in parts:
            full, hashes = signatures([text.as_buffer().to_pybytes() for text in part.column(1)], subsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([written(f, h) for f, h in zip(full, hashes, strict=True)], pa.string())], names=["doc_id", "fingerprint"])

    return own.mapInArrow(lean(run), "doc_id long, fingerprint string")


def _ranges(ids: DataFrame) -> list[int | None]:
    """Smallest id of each of the ranges that a sort by id would make; null where only null ids are."""
    spark = ids.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    ranged = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_last()).groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("least"))
    known = sorted({r.least for r in ranged.collect() if r.least is not None})
    return known or [None]


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row once, as doc_id and text, sorted by id (then text) within ranges of ids: column `range`.

    Each range ends with copies (`copy`) of the row or rows that begin the next range, the last one with
    those that begin the first. So the successor of a row is the next row of its range, and one shuffle of
    the texts is all it takes. Null ids come last.
    """
    own = plain(docs, id_col, text_col)
    least = _ranges(own.select("doc_id"))
    last, bounds = len(least) - 1, np.array([b for b in least if b is not None], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        place = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right") - 1
        return pd.Series(np.where(ids.isna(), last, np.clip(place, 0, last))).astype("int32")

    heads = F.array(*[F.lit(b).cast("long") for b in least])
    ranged = own.withColumn("range", range_of(F.col("doc_id")))
    begins = F.col("doc_id").eqNullSafe(F.element_at(heads, F.col("range") + 1))
    here = F.struct(F.col("range"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("range") + F.lit(last), F.lit(last + 1)).alias("range"), F.lit(True).alias("copy"))
    spots = F.when(begins, F.array(here, before)).otherwise(F.array(here))
    placed = ranged.select("doc_id", "text", F.explode(spots).alias("spot")).select("doc_id", "text", "spot.range", "spot.copy")
    return placed.repartitionById(last + 1, F.col("range")).sortWithinPartitions("range", "copy", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last quarter of a text (in code points, rounded down) replaced by as much of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to the edited and to the next one.

    One row per input row. The next document is that with the next larger id (ties: the larger text, so a
    repeated row follows itself; null ids last; after the last the first; a single row is its own next).
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(plain(docs)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subsets = _subsets_of(sent.value)

        def done(rows: list[tuple[int | None, str, int, bool]]) -> pa.RecordBatch:
            full, hashes = signatures([row[1].encode() for row in rows], subsets)
            # a row that begins a batch's next range has no successor here: the one before it is the last copy
            at = [k for k in range(len(rows) - 1) if not rows[k][3] and rows[k][2] == rows[k + 1][2]]
            changed = [edited(rows[k][1], rows[k + 1][1]).encode() for k in at]
            full_changed, hashes_changed = signatures(changed, subsets) if at else ([], hashes[:0])
            after = [k + 1 for k in at]
            mine = [full[k] for k in at]
            return pa.RecordBatch.from_arrays([
                pa.array([rows[k][0] for k in at], pa.int64()), pa.array([len(rows[k][1]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(text).hexdigest() for text in changed], pa.string()),
                pa.array([written(full[k], hashes[k]) for k in at], pa.string()),
                pa.array([written(f, h) for f, h in zip(full_changed, hashes_changed, strict=True)], pa.string()),
                pa.array(likenesses(mine, hashes[at], full_changed, hashes_changed)),
                pa.array(likenesses(mine, hashes[at], [full[k] for k in after], hashes[after])),
            ], names=[field.split()[0] for field in SCHEMA.split(", ")])

        held: list[tuple] = []
        for part in parts:
            held += zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)
            if len(held) > 1:
                yield done(held)
                held = held[-1:]

    return with_successors(docs).select("doc_id", "text", "range", "copy").mapInArrow(lean(run), SCHEMA)
