"""Runs of repeated words: every maximal stretch of a text that has a period, from a harmonic grid of places.

A run of period q covers several multiples of q at which the word equals the word q later. So for each q the words at
multiples of q are compared with their neighbours on this grid (about n ln n comparisons for all q), and where two
neighbouring places agree, the run is as long as the longest common extensions of the two places to both sides.

Extensions come from a difference cover: places whose remainder modulo V lies in COVER. Only suffixes that start there
are sorted, by their first V words and then by doubling, and common prefixes of neighbours in that order are kept in a
sparse table of minima. For any two places some shift below V puts both into the cover, so fewer than V words are
compared and the rest is one lookup. Texts are put one behind the other, apart by words that occur nowhere else, so
that all steps work on arrays of bounded length; only texts in which the grid found something are looked at further.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from wattframe.llm.added import add_columns
from wattframe.llm.words import NOT_BLANK

MIN_WORDS = 24
MIN_REPEATS = 3
#: A perfect difference cover: each remainder but 0 is the difference of exactly one pair.
V = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Texts are worked on in blocks of about this many words; a longer text is a block of its own.
BLOCK_WORDS = 200_000
#: Places on the grid are extended this many at a time.
BLOCK_PLACES = 500_000
RUNS = ArrayType(StructType([StructField(n, LongType()) for n in ("start", "length", "period")]))


def _shifts() -> np.ndarray:
    """By remainders of two places: the smallest shift that puts both into the cover."""
    inside = np.isin(np.arange(2 * V) % V, COVER)
    both = [[[d for d in range(V) if inside[a + d] and inside[b + d]][0] for b in range(V)] for a in range(V)]
    return np.array(both, np.int64)


SHIFT = _shifts()


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks from 0, in the order of the values."""
    return np.unique(values, return_inverse=True)[1].reshape(values.shape).astype(np.int64)


class Extensions:
    """Longest common extensions to the right of places in a sequence whose last word occurs once."""

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        pad = 2 * V
        self.words = np.concatenate([words.astype(np.int64), np.arange(-1, -1 - pad, -1)])
        places = np.arange(self.size)
        self.sample = places[np.isin(places % V, COVER)]
        self.index = np.full(self.size + pad, -1, np.int64)
        self.index[self.sample] = np.arange(len(self.sample))
        levels = self._sort()
        self._common(levels)

    def _sort(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by V, 2V, 4V .. words, until all differ."""
        columns = np.stack([self.words[self.sample + d] for d in range(V)] + [np.zeros(len(self.sample), np.int64)], axis=1)
        ranks = _dense(columns)
        while ranks.shape[1] > 1:
            ranks = _dense(ranks[:, 0::2] * (ranks.max() + 1) + ranks[:, 1::2])
        levels, step = [ranks[:, 0]], V
        while levels[-1].max() + 1 < len(self.sample):
            rank = levels[-1]
            later = self.sample + step
            follows = np.where(later < self.size, rank[self.index[np.minimum(later, self.size - 1)]] + 1, 0)
            levels.append(_dense(rank * (len(rank) + 2) + follows))
            step *= 2
        return levels

    def _common(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in sorted order, and minima over 1, 2, 4 .. of them."""
        self.rank = levels[-1]
        order = np.empty(len(self.sample), np.int64)
        order[self.rank] = np.arange(len(self.sample))
        a, b = self.sample[order[:-1]], self.sample[order[1:]]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = np.maximum(x, y) < self.size
            i, j = self.index[np.where(inside, x, 0)], self.index[np.where(inside, y, 0)]
            equal = inside & (levels[k][i] == levels[k][j])
            length += np.where(equal, V << k, 0)
        length += self._compare(a + length, b + length, np.full(len(a), V))
        self.minima = [length]
        width = 1
        while 2 * width <= len(length):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compare(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from places a and b on, at most `limit` (up to V) each."""
        same = np.zeros(len(a), np.int64)
        active = np.flatnonzero(limit > 0)
        while len(active):
            x, y = a[active] + same[active], b[active] + same[active]
            equal = self.words[np.minimum(x, self.size)] == self.words[np.minimum(y, self.size + 1)]
            active = active[equal]
            same[active] += 1
            active = active[same[active] < limit[active]]
        return same

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from each a and b (a < b, within the sequence) on."""
        shift = SHIFT[a % V, b % V]
        same = self._compare(a, b, shift)
        on = np.flatnonzero((same == shift) & (b + shift < self.size))
        x, y = self.rank[self.index[a[on] + shift[on]]], self.rank[self.index[b[on] + shift[on]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        found = np.empty(len(on), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.minima[k]
            found[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        same[on] += found
        return same


def _grid(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods): multiples of each period at which the word and the next word on the grid repeat."""
    places, periods = [], []
    for q in range(1, longest // MIN_REPEATS + 1):
        column = words[::q]
        same = column[1:] == column[:-1]
        twice = same[1:] & same[:-1]
        if twice.any():
            at = np.flatnonzero(twice)
            places.append(at * q)
            periods.append(np.full(len(at), q, np.int64))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one behind the other, each followed by a word of its own, and where they start."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = [np.array([-1 - i]) for i in range(len(texts))]
    return np.concatenate(list(chain.from_iterable(zip(texts, ends, strict=True)))), np.cumsum(sizes) - sizes


def _extended(a: np.ndarray, q: np.ndarray, forward: Extensions, backward: Extensions) -> np.ndarray:
    """Distinct (start, length, period) of the stretches around places a that have period q and are long enough."""
    right = forward.common(a, a + q)
    left = np.zeros(len(a), np.int64)
    inner = np.flatnonzero(a > 0)
    # the places before a and a + q, read backwards
    mirrored = forward.size - 1 - a[inner]
    left[inner] = backward.common(mirrored - q[inner], mirrored)
    length = left + right + q
    enough = length >= np.maximum(MIN_WORDS, MIN_REPEATS * q)
    return np.unique(np.stack([a - left, length, q], axis=1)[enough], axis=0)


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text (word numbers, 0 and up) its runs as rows (start, length, period), by start, then period."""
    none = np.empty((0, 3), np.int64)
    result = [none] * len(texts)
    long_enough = [i for i, t in enumerate(texts) if len(t) >= MIN_WORDS]
    if not long_enough:
        return result
    words, starts = _joined([texts[i] for i in long_enough])
    places, _ = _grid(words, max(len(texts[i]) for i in long_enough))
    hit = [long_enough[i] for i in np.unique(np.searchsorted(starts, places, "right") - 1)]
    if not hit:
        return result
    words, starts = _joined([texts[i] for i in hit])
    a, q = _grid(words, max(len(texts[i]) for i in hit))
    forward = Extensions(words)
    # the last word stays last, as it occurs once
    backward = Extensions(np.concatenate([words[:-1][::-1], words[-1:]]))
    parts = [_extended(a[i:i + BLOCK_PLACES], q[i:i + BLOCK_PLACES], forward, backward) for i in range(0, len(a), BLOCK_PLACES)]
    found = np.unique(np.concatenate(parts), axis=0)
    # of a stretch found with several periods the smallest counts
    first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)] if len(found) else np.empty(0, bool)
    found = found[first]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(starts, found[:, 0], "right") - 1
    cuts = np.searchsorted(text, np.arange(len(hit) + 1))
    for i, doc in enumerate(hit):
        rows = found[cuts[i]:cuts[i + 1]].copy()
        rows[:, 0] -= starts[i]
        result[doc] = rows
    return result


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words without those that a run holds after its first period, joined by blanks."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def _block(words: list[list[str]]) -> list[pa.Array]:
    number: dict[str, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in words]
    found = runs_of(texts)
    flat = np.concatenate(found)
    offsets = np.cumsum([0, *map(len, found)])
    rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    collapsed = pa.array([collapse(t, r) for t, r in zip(words, found, strict=True)], pa.string())
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), collapsed]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `runs` (by start, then period; places are word numbers) and `collapsed`.

    A run has at least 24 words and three periods, its period is its smallest, and no neighbouring word continues it.
    Columns of these names are replaced. Null, empty and blank texts have no words, no runs and an empty `collapsed`.
    Whole texts are read, in blocks of bounded length (a longer text is a block of its own); equal rows are treated
    alike, nothing is shuffled.
    """
    word = re.compile(NOT_BLANK)

    def found(texts: pa.Array) -> Iterator[list[pa.Array]]:
        part, size = [], 0
        for value in texts:
            part.append(word.findall(value.as_py() or ""))
            size += len(part[-1])
            if size >= BLOCK_WORDS:
                yield _block(part)
                part, size = [], 0
        if part:
            yield _block(part)

    return add_columns(docs, F.col(text).cast("string"), {"runs": RUNS, "collapsed": StringType()}, lambda: found)
