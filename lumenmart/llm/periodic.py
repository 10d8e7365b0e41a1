"""Periodic runs of words by internal pattern matching.

Documents of a batch form one string of numbers in which no two documents share a symbol, so equal
stretches always lie in one document. Prefix doubling names all stretches of 1, 2, 4, ... words; the
names order the suffixes (the suffix array), and a block of 2^k words owns the interval of suffixes that
begin with it. A wavelet matrix over the suffix array answers which occurrences of a block start in a
window of the text (range count and range successor).

Blocks lie at multiples of their length. A run of period q is long enough that some block of the level
that fits q recurs q words later inside the run, so each block asks only the windows next to it. The
occurrences that start within one window as wide as the block form an arithmetic progression:

* one or two occurrences: each distance to the block is a candidate period;
* more: their step is the period of the block. The block's own periodic stretch and that of the
  occurrences are extended; a longer period must carry an end of one to the same end of the other, or
  join two stretches that overlap, which leaves the distances of `_progression`.

Candidates are extended by comparing names of halving length in both directions, which is exact; of the
periods of one stretch the smallest holds. Nothing but repeated blocks costs more than the doubling.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenmart.llm.common import lean, plain, spread, tune

SHORTEST = 12
#: Words worked on together; a longer document is worked on alone.
TOGETHER = 1 << 16
#: Lowest level: blocks of 4 words at every second place, as 12 words of period 6 hold no more.
LOWEST = 2


class Names:
    """Names of all stretches of 2^k words: equal names, equal stretches. Also the suffixes by them."""

    def __init__(self, symbols: np.ndarray) -> None:
        size = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(size, np.int64)
        ordered = symbols[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        lengths = np.diff(np.concatenate((starts, [size])))
        rank[order] = np.repeat(starts, lengths)
        self.levels = [rank.astype(np.int32)]
        #: per level from LOWEST on: places whose stretch recurs, and the interval of suffixes they own
        self.recurring: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = order[np.repeat(lengths, lengths) > 1]  # in suffix order
        self.suffixes = order
        width = 1
        while len(active):
            own = rank[active]
            after = active + width
            follows = np.where(after < size, rank[np.minimum(after, size - 1)], -1)
            key = own * (size + 1) + follows + 1
            sort = np.argsort(key, kind="stable")
            active, key, own = active[sort], key[sort], own[sort]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], own[1:] != own[:-1]))
            at = np.arange(len(active))
            # place in the whole suffix array: start of the old group, then the offset within it
            place = own + at - np.maximum.accumulate(np.where(group, at, 0))
            self.suffixes[place] = active
            first = np.flatnonzero(new)
            lengths = np.diff(np.concatenate((first, [len(active)])))
            names = np.repeat(place[first], lengths)
            rank = rank.copy()
            rank[active] = names
            self.levels.append(rank.astype(np.int32))
            width *= 2
            many = np.repeat(lengths, lengths) > 1
            active = active[many]
            if len(self.levels) > LOWEST:
                low = names[many]
                self.recurring.append((active, low, low + np.repeat(lengths, lengths)[many]))

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Words from `one` and `two` on that agree."""
        return self._agree(one, two, 1)

    def common_before(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Words before `one` and `two` that agree, read backwards."""
        return self._agree(one, two, -1)

    def _agree(self, one: np.ndarray, two: np.ndarray, way: int) -> np.ndarray:
        size, found = len(self.levels[0]), np.zeros(len(one), np.int64)
        # no stretch of the highest level recurs, so each level is needed once
        for level in range(len(self.levels) - 1, -1, -1):
            hit = self._equal(one + way * found, two + way * found, level, way, size)
            found[hit] += 1 << level
        return found

    def _equal(self, one: np.ndarray, two: np.ndarray, level: int, way: int, size: int) -> np.ndarray:
        if way < 0:
            one, two = one - (1 << level), two - (1 << level)
        inside = (one >= 0) & (two >= 0) & (one < size) & (two < size)
        names = self.levels[level]
        return inside & (names[np.where(inside, one, 0)] == names[np.where(inside, two, 0)])


class Wavelet:
    """Wavelet matrix over a row of numbers: how many of a range are below a bound, and the k-th smallest."""

    def __init__(self, values: np.ndarray, bound: int) -> None:
        self.bits = max(1, int(bound).bit_length())
        self.zeros, self.borders = [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~ones))).astype(np.int32))
            self.borders.append(len(values) - int(ones.sum()))
            values = np.concatenate((values[~ones], values[ones]))

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Numbers below `bound` among the places low to high."""
        count = np.zeros(len(low), np.int64)
        past = bound >> self.bits > 0
        whole = high - low
        for level, (zeros, border) in enumerate(zip(self.zeros, self.borders, strict=True)):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            low_zeros, high_zeros = zeros[low], zeros[high]
            count += np.where(one, high_zeros - low_zeros, 0)
            low = np.where(one, border + low - low_zeros, low_zeros)
            high = np.where(one, border + high - high_zeros, high_zeros)
        return np.where(past, whole, count)

    def smallest(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The number with `number` smaller ones among the places low to high: with `below`, the range successor."""
        value = np.zeros(len(low), np.int64)
        number = number.copy()
        for level, (zeros, border) in enumerate(zip(self.zeros, self.borders, strict=True)):
            low_zeros, high_zeros = zeros[low], zeros[high]
            inside = (high_zeros - low_zeros).astype(np.int64)
            one = number >= inside
            number -= np.where(one, inside, 0)
            value = value << 1 | one
            low = np.where(one, border + low - low_zeros, low_zeros)
            high = np.where(one, border + high - high_zeros, high_zeros)
        return value


def _progression(names: Names, start: np.ndarray, first: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate places and periods of blocks that recur `count` (3 or more) times in steps of their own period."""
    left_one = start - names.common_before(start, start + step)
    right_one = start + step + names.common(start, start + step)
    left_two = first - names.common_before(first, first + step)
    right_two = first + step + names.common(first, first + step)
    apart = left_one != left_two  # else multiples of the step, which lower levels find
    start, first, step, count = start[apart], first[apart], step[apart], count[apart]
    by_left, by_right = (left_two - left_one)[apart], (right_two - right_one)[apart]
    touching = (right_one - left_two)[apart] >= 0
    shift, least, most = first - start, np.minimum(by_left, by_right), np.maximum(by_left, by_right)
    # terms 0..count-1 of shift + term * step; up to `least` where the stretches meet, else around both ends only
    upto = np.floor_divide(least - shift, step)
    around = [upto, upto + 1, np.floor_divide(most - shift, step), -np.floor_divide(shift - most, step), np.floor_divide(most - shift, step) + 1]
    places, periods = [], []
    for term in around:
        good = (term >= 0) & (term < count)
        places.append(start[good])
        periods.append((shift + term * step)[good])
    many = np.where(touching, np.clip(upto, 0, count), 0)
    places.append(np.repeat(start, many))
    term = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    periods.append(np.repeat(shift, many) + term * np.repeat(step, many))
    return np.concatenate(places), np.concatenate(periods)


def runs_of(symbols: np.ndarray, offset: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All maximal runs of a string as rows start, length, period, by start and period.

    `symbols` numbers the words; documents lie back to back and share no symbol. `offset` is the place of
    each word within its document, which decides where blocks begin.
    """
    nothing = np.zeros((0, 3), np.int64)
    if len(symbols) < shortest:
        return nothing
    names = Names(symbols)
    if not names.recurring or not len(names.recurring[0][0]):
        return nothing
    # only suffixes whose lowest block recurs can be asked for
    kept = np.zeros(len(symbols) + 1, np.int64)
    lowest = names.levels[LOWEST][names.recurring[0][0]]
    spots = np.sort(lowest + _within(np.sort(lowest), lowest))
    kept[spots + 1] = 1
    compact = np.cumsum(kept)
    wavelet = Wavelet(names.suffixes[spots], len(symbols))
    places, periods = [], []
    for level, (start, low, high) in enumerate(names.recurring, LOWEST):
        block = 1 << level
        stride = block if level > LOWEST else block // 2
        here = offset[start] % stride == 0
        start, low, high = start[here].astype(np.int64), compact[low[here]], compact[high[here]]
        if not len(start):
            continue
        edges = range(1, 4 * block + 2, block) if level == LOWEST else range(2 * block - 1, 4 * block, block)
        counts = [wavelet.below(low, high, start + edge) for edge in edges]
        for before, upto in itertools.pairwise(counts):
            number = upto - before
            some = np.flatnonzero(number > 0)
            first = wavelet.smallest(low[some], high[some], before[some])
            places.append(start[some])
            periods.append(first - start[some])
            two = some[number[some] > 1]
            first = first[number[some] > 1]
            second = wavelet.smallest(low[two], high[two], before[two] + 1)
            pair = number[two] == 2
            places.append(start[two[pair]])
            periods.append((second - start[two])[pair])
            more = ~pair
            if more.any():
                where, distance = _progression(names, start[two[more]], first[more], (second - first)[more], number[two[more]])
                places.append(where)
                periods.append(distance)
    if not places:
        return nothing
    start, period = np.concatenate(places), np.concatenate(periods)
    left = start - names.common_before(start, start + period)
    length = start + period + names.common(start, start + period) - left
    good = length >= np.maximum(shortest, 2 * period)
    found = np.stack([left[good], length[good], period[good]], 1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if not len(found):
        return nothing
    # of the periods of one stretch the smallest
    new = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _within(ordered: np.ndarray, names: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... along equal names, which are sorted."""
    at = np.arange(len(names))
    return at - np.searchsorted(ordered, names)


def extended(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words after the edit the id asks for: every tenth id repeats a few words from some place on."""
    if not words or doc_id is None:
        return words
    chosen, rest = zlib.crc32(str(doc_id).encode()) % 10, zlib.crc32(str(doc_id).encode()) // 10
    if chosen:
        return words
    n = len(words)
    begin = rest % n
    period = 1 + (n - begin) // (3 + rest % 8)
    tail = n - begin
    return words[:begin] + (words[begin : begin + period] * (tail // period + 1))[:tail]


def _summaries(documents: list[list[bytes]]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Per document its runs (start, length, period) and the words that stay."""
    sizes = np.array([len(words) for words in documents])
    symbols, base = np.empty(int(sizes.sum()), np.int64), 0
    ends = np.cumsum(sizes)
    for words, end in zip(documents, ends.tolist(), strict=True):
        first: dict[bytes, int] = {}
        symbols[end - len(words) : end] = list(map(first.setdefault, words, itertools.count(base)))
        base += len(words)
    offset = np.arange(len(symbols)) - np.repeat(ends - sizes, sizes)
    runs = runs_of(symbols, offset)
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    bounds = np.searchsorted(owner, np.arange(len(documents) + 1))
    for number, words in enumerate(documents):
        own = runs[bounds[number] : bounds[number + 1]].copy()
        own[:, 0] -= ends[number] - sizes[number]
        yield own, _kept(words, own) if len(own) else words


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words outside every run, or within the first period of each run they lie in."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)
DIGESTS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _row(doc_id: int | None, runs: np.ndarray, kept: list[bytes], whole: bool) -> tuple:
    collapsed = b" ".join(kept)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs.tolist())
    longest = (None,) * 4
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        longest = (start, length, period, 1000 * length // period)
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    rest = ([dict(zip(("start", "length", "period"), run, strict=True)) for run in runs.tolist()], collapsed.decode("utf-8", "replace")) if whole else (None, None)
    return (doc_id, len(runs), *longest, *digests, *rest)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: bool = False, whole: bool = False) -> DataFrame:
    """Runs of words of every document, one row per input row.

    A run is a maximal stretch of words with smallest period q of at least 12 and 2q words; words are
    separated by ASCII blanks. Columns: `DIGESTS` and, filled if `whole`, all runs (`runs`) and the text
    without repeated periods (`collapsed`). With `edit` the words first change as `extended` says. Null
    and empty texts have no run and an empty collapsed text; rows with a null id are never edited, and
    repeated rows get equal results. An empty table gives no rows. Rows are independent of each other:
    no shuffle but for spreading a small input.
    """
    tune(docs.sparkSession)
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
    names = [field.split()[0] for field in SCHEMA.split(", ")[:8]] + ["runs", "collapsed"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, documents):
            rows = [_row(doc_id, runs, kept, whole) for doc_id, (runs, kept) in zip(ids, _summaries(documents), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for part in parts:
            ids, documents, size = [], [], 0
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                doc_id = doc_id.as_py()
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                words = extended(words, doc_id) if edit else words
                if size and size + len(words) > TOGETHER:
                    yield done(ids, documents)
                    ids, documents, size = [], [], 0
                ids.append(doc_id)
                documents.append(words)
                size += len(words)
            if ids:
                yield done(ids, documents)

    return spread(plain(docs, id_col, text_col)).mapInArrow(lean(run), SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of `word_runs` over the edited words."""
    return word_runs(docs, edit=True).select(*[F.col(name) for name in DIGESTS])
