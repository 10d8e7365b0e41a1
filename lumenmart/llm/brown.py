"""Language-model scores by Brown classes.

Every word belongs to one class; P(word | before) = P(class | class before) * P(word | class). Counts come
from all training texts:

1. Words are counted (`train_tokens`, base score, vocabulary).
2. The `EXCHANGE` most frequent words are put into classes by exchange: in turn, each word moves to the
   class that raises the likelihood of the class bigrams most. Moves depend on each other, so this step
   runs on the driver, over a table of at most EXCHANGE x EXCHANGE counts whatever the corpus.
3. The other words of the bounded vocabulary (`VOCABULARY`) join the class that fits their neighbours
   best by the same measure. Words beyond it form one class. Inside its class each word has its
   discounted share; what the discounts free is the probability of a word never seen.
4. Class transitions are counted over all training tokens and smoothed with the class frequencies.

Tables whose size follows the vocabulary of the corpus stay distributed: a text's rare words meet their
counts by a join. Only tables bounded by the parameters are sent to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.llm.common import lean, plain, row_key, spread, stage, tune

FOLDS, HELD_FOLD = 7, 2
VOCABULARY = 131_072
EXCHANGE = 2048
CLASSES = 64
SWEEPS = 6
SMOOTH = 20.0
MEMORY = 500_000
END = b""


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end of the text is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _texts(part: pa.RecordBatch) -> list:
    return part.column(part.schema.get_field_index("text")).to_pylist()


def word_counts(train: DataFrame) -> DataFrame:
    """Count of every token of the training texts, ends included (the empty word)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return batch

        for part in parts:
            for text in _texts(part):
                for word in words_of(text):
                    counts[word] = counts.get(word, 0) + 1
                counts[END] = counts.get(END, 0) + 1
                if len(counts) > MEMORY:
                    yield out()
        if counts:
            yield out()

    return train.select("text").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The bounded vocabulary, most frequent first; numbers of its words and of the end, `rare` for all others."""

    words: list[bytes]
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.number = {w: i for i, w in enumerate(self.words)}
        self.rare, self.end = len(self.words), self.number[END]

    def __reduce__(self):
        return Head, (self.words, self.counts)

    def ids(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        words = words_of(text)
        get, rare = self.number.get, self.rare
        return np.array([get(w, rare) for w in words] + [self.end], dtype=np.int64), words


class Sent:
    """A broadcast value that each worker unpacks once."""

    def __init__(self, spark, value) -> None:
        self._sent = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._sent.value


def _head(counts: DataFrame, vocabulary: int) -> Head:
    found = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(vocabulary).collect()
    end = counts.where(F.col("word") == F.lit(END)).collect()
    rows = sorted([(bytes(r.word), r.c) for r in [*found, *end]], key=lambda r: (-r[1], r[0]))
    if not end:
        rows.append((END, 0))
    return Head([w for w, _ in rows], np.array([c for _, c in rows], dtype=np.int64))


def _adjacent(head: Head, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all neighbouring tokens of a batch; the end also stands before each text."""
    pieces = [head.ids(text)[0] for text in _texts(part)]
    return np.concatenate([np.concatenate(([head.end], p[:-1])) for p in pieces]), np.concatenate(pieces)


def word_pairs(train: DataFrame, sent: Sent, most: int) -> DataFrame:
    """Bigram counts among the `most` first words: a, b, n."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size = sent.value, [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((codes // most).astype(np.int32)), pa.array((codes % most).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for part in parts:
            if not part.num_rows:
                continue
            before, after = _adjacent(head, part)
            keep = (before < most) & (after < most)
            held.append(before[keep] * most + after[keep])
            size += int(keep.sum())
            if size > 8_000_000:
                yield out()
                size = 0
        if held:
            yield out()

    return train.select("text").mapInArrow(lean(run), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def move_gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Likelihood gained by adding each word to each class of a class bigram table that lacks it.

    table: K x K, or one such table per word; after, before: words x K counts of the classes that follow and
    precede the word; own: how often the word follows itself.
    """
    table = np.broadcast_to(table, (len(after), *table.shape[-2:]))
    k = np.arange(table.shape[-1])
    old = _x_log_x(table)
    rows = _x_log_x(table + after[:, None, :]) - old
    columns = _x_log_x(table + before[:, :, None]) - old
    diagonal = table[:, k, k]
    corner = _x_log_x(diagonal + after + before + own[:, None]) - _x_log_x(diagonal)
    gain = rows.sum(2) - rows[:, k, k] + columns.sum(1) - columns[:, k, k] + corner
    left, right = table.sum(2), table.sum(1)
    left_more, right_more = (after.sum(1) + own)[:, None], (before.sum(1) + own)[:, None]
    return gain - (_x_log_x(left + left_more) - _x_log_x(left)) - (_x_log_x(right + right_more) - _x_log_x(right))


def exchange(pairs: np.ndarray, k: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word of a (bounded) square table of bigram counts; words start spread by frequency.

    Words take turns: one leaves its class and joins the one that raises the likelihood most. A sweep
    without a move ends the search.
    """
    m = len(pairs)
    classes = np.arange(m) % k
    own, member = pairs.diagonal().astype(float), np.eye(k)[classes]
    after, before = pairs @ member, pairs.T @ member
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            old = classes[w]
            follow, lead = after[w].copy(), before[w].copy()
            follow[old] -= own[w]
            lead[old] -= own[w]
            table[old] -= follow
            table[:, old] -= lead
            table[old, old] -= own[w]
            gain = move_gains(table, follow[None], lead[None], own[w : w + 1])[0]
            new = int(gain.argmax())
            new = new if gain[new] > gain[old] + 1e-9 else old
            table[new] += follow
            table[:, new] += lead
            table[new, new] += own[w]
            if new != old:
                moved += 1
                classes[w] = new
                after[:, old] -= pairs[:, w]
                after[:, new] += pairs[:, w]
                before[:, old] -= pairs[w]
                before[:, new] += pairs[w]
        if not moved:
            break
    return classes


def _square(pairs: DataFrame, m: int) -> np.ndarray:
    """The bigram counts of the m exchanged words; at most m x m cells reach the driver."""
    found = pairs.toArrow()
    out = np.zeros((m, m))
    out[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return out


def _adopted(train: DataFrame, sent: Sent, classes: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """Classes of the words after the exchanged ones, by the classes of their neighbours there."""
    spark, m = train.sparkSession, len(classes)
    known, total = Sent(spark, classes), sent.value.rare

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size = sent.value, [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            word = codes // (2 * k)
            first = np.flatnonzero(np.concatenate(([True], np.diff(word) != 0)))
            ends = np.concatenate((first[1:], [len(word)]))
            cells, counts = (codes % (2 * k)).astype(np.uint8), n.astype("<u4")
            return pa.RecordBatch.from_arrays([
                pa.array(word[first].astype(np.int32)), pa.array([cells[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary()),
                pa.array([counts[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary()),
            ], names=["word", "cells", "counts"])

        for part in parts:
            if not part.num_rows:
                continue
            before, after = _adjacent(head, part)
            one = (before >= m) & (before < total) & (after < m)
            two = (after >= m) & (after < total) & (before < m)
            held.append(np.concatenate((before[one] * 2 * k + known.value[after[one]], after[two] * 2 * k + k + known.value[before[two]])))
            size += len(held[-1])
            if size > 8_000_000:
                yield out()
                size = 0
        if size:
            yield out()

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[part.column(c).to_pylist() for c in range(3)] for part in parts]
        names, place = np.unique(np.array([w for h in held for w in h[0]], dtype=np.int64), return_inverse=True)
        if not len(names):
            return
        sums, at = np.zeros((len(names), 2 * k)), 0
        for _, cells, counts in held:
            for c, n in zip(cells, counts, strict=True):
                sums[place[at], np.frombuffer(c, np.uint8)] += np.frombuffer(n, "<u4")
                at += 1
        best = np.concatenate([
            move_gains(table, sums[i : i + 128, :k], sums[i : i + 128, k:], np.zeros(len(sums[i : i + 128]))).argmax(1) for i in range(0, len(sums), 128)
        ])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best)], names=["word", "class"])

    rows = train.select("text").mapInArrow(lean(run), "word int, cells binary, counts binary").repartition(max(1, min(256, (total - m) // 512)), "word")
    everything = np.concatenate((classes, np.arange(max(0, total - m)) % k))
    for r in rows.mapInArrow(fit, "word long, class long").collect():
        everything[r.word] = r["class"]
    return everything


def _transitions(train: DataFrame, sent: Sent, classes: Sent, k: int) -> np.ndarray:
    """Class bigram counts over all tokens; class k: words beyond the vocabulary, k + 1: the end."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2) ** 2, dtype=np.int64)
        for part in parts:
            if part.num_rows:
                before, after = _adjacent(sent.value, part)
                total += np.bincount(classes.value[before] * (k + 2) + classes.value[after], minlength=(k + 2) ** 2)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    table = np.zeros((k + 2) ** 2)
    for r in train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    return table.reshape(k + 2, k + 2)


@dataclass
class Model:
    """`counts`: word, c (distributed). The rest is bounded: vocabulary, classes, log10 tables, rare-word constants.

    `unseen`: log10 probability, after each class, of a word that training has not."""

    counts: DataFrame
    head: Sent
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    unseen: np.ndarray
    train_tokens: int
    vocabulary: int
    rare_tokens: int
    rare_words: int
    discount: float


def fit(train: DataFrame, vocabulary: int = VOCABULARY, most: int = EXCHANGE, k: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    """Learn from the `text` of all rows; null texts are empty ones."""
    spark = train.sparkSession
    counts = stage(word_counts(train))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    head = _head(counts, vocabulary)
    sent, most = Sent(spark, head), min(most, head.rare)
    pairs = _square(word_pairs(train, sent, most), most)
    classes = exchange(pairs, k, sweeps)
    member = np.eye(k)[classes]
    table = member.T @ pairs @ member
    classes = _adopted(train, sent, classes, table, k) if head.rare > most else classes
    classes = np.concatenate((classes, [k]))
    classes[head.end] = k + 1
    together = _transitions(train, sent, Sent(spark, classes), k)
    share = (together.sum(0) + 1) / (together.sum() + k + 2)
    transition = np.log10((together + SMOOTH * share) / (together.sum(1, keepdims=True) + SMOOTH))
    rare_tokens, rare_words = int(totals.n - head.counts.sum()), int(totals.v - (head.counts > 0).sum())
    discount = min(0.95, totals.n1 / (totals.n1 + 2 * totals.n2)) if totals.n1 and totals.n2 else 0.5
    size = np.bincount(classes[:-1], head.counts, k + 2)
    types = np.bincount(classes[:-1], head.counts > 0, k + 2)
    size[k], types[k], types[k + 1] = rare_tokens, rare_words, 0
    freed = np.where(size > 0, discount * types / np.maximum(size, 1), 1.0)
    freed[k + 1] = 0.0
    counted = np.maximum(head.counts - np.where(np.arange(head.rare) == head.end, 0.0, discount), 1e-9)
    emission = np.append(np.log10(counted / np.maximum(size[classes[:-1]], 1)), 0.0)
    emission[head.end] = 0.0
    unseen = np.log10(np.maximum(10.0**transition @ freed, 1e-12))
    return Model(counts, sent, classes, transition, emission, unseen, int(totals.n), int(totals.v), rare_tokens, rare_words, discount)


SCORED = "doc_id long, text_key long, word binary, m long, other double, copies long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of doc_id, text: n_tokens, n_known, base_score, score (log10 probabilities of the whole text and its end)."""
    spark = docs.sparkSession
    logs = Sent(spark, (model.classes, model.transition, model.emission, model.unseen))
    head, scale = model.head, math.log10(model.train_tokens + model.vocabulary + 1)
    names = [f.split()[0] for f in SCORED.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, emission, unseen = logs.value
        own = head.value
        base = np.append(np.log10(own.counts + 1.0), 0.0) - scale
        for part in parts:
            ids_, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
            known = ([], [], [], [], [], [])
            rare = ([], [], [], [], [])
            for doc_id, key, text in zip(ids_, keys, _texts(part), strict=True):
                ids, words = own.ids(text)
                group = classes[ids]
                common = ids[ids < own.rare]
                before = np.concatenate(([classes[own.end]], group[:-1]))
                step = transition[before, group]
                value = step.sum() + emission[common].sum()
                for column, x in zip(known, (doc_id, key, len(ids), int((own.counts[common] > 0).sum()), float(base[common].sum()), float(value)), strict=True):
                    column.append(x)
                # beyond the vocabulary: how often, and what changes in the score if training lacks the word
                seen: dict[bytes, int] = {}
                change: dict[bytes, float] = {}
                places = np.flatnonzero(ids == own.rare)
                for at, x in zip(places.tolist(), (unseen[before[places]] - step[places]).tolist(), strict=True):
                    word = words[at]
                    seen[word] = seen.get(word, 0) + 1
                    change[word] = change.get(word, 0.0) + x
                rare[0].extend([doc_id] * len(seen))
                rare[1].extend([key] * len(seen))
                rare[2].extend(seen)
                rare[3].extend(seen.values())
                rare[4].extend(change.values())
            n = len(known[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(known[0], pa.int64()), pa.array(known[1], pa.int64()), pa.nulls(n).cast(pa.binary()), pa.array([0] * n, pa.int64()), pa.array(np.zeros(n)), pa.array([1] * n, pa.int64()),
                pa.array(known[2], pa.int64()), pa.array(known[3], pa.int64()), pa.array(known[4], pa.float64()), pa.array(known[5], pa.float64()),
            ], names=names)
            n = len(rare[0])
            nothing, zero = pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n))
            yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), pa.array(rare[1], pa.int64()), pa.array(rare[2], pa.binary()), pa.array(rare[3], pa.int64()), pa.array(rare[4], pa.float64()), nothing, nothing, nothing, zero, zero], names=names)

    parts = stage(docs.select(*row_key(), "text").mapInArrow(lean(run), SCORED))
    times, c = F.col("m").cast("double"), F.coalesce("c", F.lit(0))
    looked = parts.where("word is not null").select("doc_id", "text_key", "word", "m", "other").join(model.counts, "word", "left")
    rare = looked.groupBy("doc_id", "text_key").agg(
        F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("n_known"), F.sum(times * (F.log10(c + 1.0) - scale)).alias("base"),
        F.sum(F.when(c > 0, times * F.log10((c - model.discount) / max(1, model.rare_tokens))).otherwise(F.col("other"))).alias("score"),
    )
    whole = parts.where("word is null").select("doc_id", "text_key", "copies", "n_tokens", "n_known", "base", "score")
    joined = whole.unionByName(rare.select("doc_id", "text_key", F.lit(0).alias("copies"), F.lit(0).alias("n_tokens"), "n_known", "base", "score"))
    sums = joined.groupBy("doc_id", "text_key").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "base", "score")])
    # rows equal in id and text were added up; each gets its part
    each = sums.select("doc_id", *[(F.col(x) / F.col("copies")).alias(x) for x in ("n_tokens", "n_known", "base", "score")], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.col("base").alias("base_score"), "score")


def scored_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id modulo 7 is not 2; null ids count as training rows. Null
    texts are empty and consist of their end. Repeated rows are rows like others. A word never seen in
    training is one further word of the model, as it is in the base score.
    """
    tune(docs.sparkSession)
    rows = spread(plain(docs))
    model = fit(rows.where(~held_out()), **options)
    return score(rows, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
