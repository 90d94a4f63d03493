"""Periodic runs of words, found from an enhanced suffix array without building a suffix tree.

The words of many documents lie in one array, each document with an alphabet and an end mark of its own, so
that nothing matches across documents. Suffixes are ranked by prefix doubling; the ranks of every level
are kept and answer in a few look-ups whether two stretches are equal. The boundaries of each LCP
interval come from the LCP array alone. In an interval of depth d all suffixes but those of the largest
child are tested: if the suffix d places further (or back) lies in the interval and in another child, a
square of period d starts there that cannot be shifted to the right (a branching tandem repeat). Each is
rotated to the left as far as the period holds, which gives a run; equal stretches found under multiples
of a period are merged into the one with the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorcast.llm.words import ascii_words, doc_columns, hash_memo, slices, windows, word_hashes

LEAST_WORDS = 24
LEAST_PERIODS = 3
TOGETHER = 400_000  # words that share a suffix array; a longer document has its own
FLAT = 4_000_000  # suffixes that are tested at a time

# Gives the place in a document that each place of it is filled from, or None to leave it as it is.
Arrangement = Callable[[int | None, int], np.ndarray | None]


class SuffixArray:
    """Suffix array, its inverse and LCP values of ``codes``, in which end marks are unique.

    ``levels[k]`` ranks all places by their first 2**k codes, equal ones alike."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        ranks = np.empty(n, np.int32)
        self._rank(ranks, order, np.arange(n), codes[order])
        self.levels = [ranks]
        array = order.astype(np.int32)
        width = 1
        while True:
            shared = np.bincount(ranks, minlength=n)[ranks[array]] > 1
            slots = np.flatnonzero(shared)
            if not len(slots):
                break
            places = array[slots].astype(np.int64)
            # Places that share their first codes have no end mark among them, so the next ones exist.
            key = ranks[places].astype(np.int64) * n + ranks[places + width]
            at = np.argsort(key, kind="stable")
            places = places[at]
            array[slots] = places
            ranks = ranks.copy()
            self._rank(ranks, places, slots, key[at])
            self.levels.append(ranks)
            width *= 2
        self.array, self.inverse = array, ranks
        self.lcp = np.zeros(n + 1, np.int64)  # lcp[j]: of the suffixes at j - 1 and j
        if n > 1:
            self.lcp[1:n] = self._common(array[:-1].astype(np.int64), array[1:].astype(np.int64))

    @staticmethod
    def _rank(ranks, places, slots, keys) -> None:
        """Places in sorted order get the slot of the first of their equals."""
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        ranks[places] = slots[first][np.cumsum(first) - 1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, for each pair."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[k]
            length += (ranks[a + length] == ranks[b + length]).astype(np.int64) << k
        return length

    def back(self, a: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many places before a in a row equal those d further."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            ranks, at = self.levels[k], a - length - (1 << k)
            inside = np.maximum(at, 0)
            length += ((at >= 0) & (ranks[inside] == ranks[inside + d])).astype(np.int64) << k
        return length


def _bounds(lcp: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary in ``least`` the nearest boundaries before and after it with a smaller value, by
    descent over minima of stretches that double in length. The first and last values are below all."""
    tables = [lcp]
    while 2 << len(tables) <= len(lcp):
        half = tables[-1]
        step = 1 << (len(tables) - 1)
        tables.append(np.minimum(half[:-step], half[step:]))
    value = lcp[least]
    before, after = least.copy(), least + 1  # all of [before, least] and [least, after) are not smaller
    for k in range(len(tables) - 1, -1, -1):
        step, table = 1 << k, tables[k]
        at = before - step
        ok = (at >= 0) & (table[np.maximum(at, 0)] >= value)
        before = np.where(ok, at, before)
        ok = after + step <= len(lcp)
        ok &= table[np.where(ok, after, 0)] >= value
        after = np.where(ok, after + step, after)
    return before - 1, after


def branching_squares(suffixes: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that do not go on with their period to the right."""
    lcp = suffixes.lcp.copy()
    lcp[0] = lcp[-1] = -1
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = _bounds(lcp, inner)  # the interval is [low, high)
    order = np.lexsort((inner, high, low))
    inner, low, high = inner[order], low[order], high[order]
    first = np.ones(len(inner), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    depth = lcp[inner]
    # A child starts at each boundary and ends at the next of its interval; one more starts the interval.
    ends = np.where(np.append(first[1:], True), high, np.append(inner[1:], 0))
    begin = np.concatenate([low[first], inner])
    end = np.concatenate([inner[first], ends])
    interval = np.concatenate([np.arange(first.sum()), np.cumsum(first) - 1])
    low, high, depth = low[first], high[first], depth[first]
    size = end - begin
    order = np.lexsort((begin, -size, interval))
    small = np.ones(len(order), bool)
    small[np.searchsorted(interval[order], np.arange(len(low)))] = False  # the largest child
    chosen = order[small]
    begin, end, interval, size = begin[chosen], end[chosen], interval[chosen], size[chosen]
    starts, periods = [], []
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLAT, "right")))
        part = slice(at, until)
        at = until
        counts = size[part]
        own = np.repeat(np.arange(len(counts)), counts)
        slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[part][own]
        place = suffixes.array[slot].astype(np.int64)
        lo, hi, d = (x[interval[part]][own] for x in (low, high, depth))
        child_lo, child_hi = begin[part][own], end[part][own]
        for other, start in ((place + d, place), (place - d, place - d)):
            met = suffixes.inverse[np.maximum(other, 0)]
            square = (other >= 0) & (met >= lo) & (met < hi) & ((met < child_lo) | (met >= child_hi))
            starts.append(start[square])
            periods.append(d[square])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in ``codes``, by start and then period."""
    suffixes = SuffixArray(codes)
    start, period = branching_squares(suffixes)
    # The run ends with the square; its start is as far to the left as the period holds.
    end = start + 2 * period
    start = start - suffixes.back(start, period)
    length = end - start
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, end, period = start[enough], end[enough], period[enough]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # A stretch found under multiples of its period, or from both sides.
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[once], end[once], period[once]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _suspects(hashes: list[np.ndarray]) -> np.ndarray:
    """Which documents can have a run at all: one of at least 24 words and three periods repeats a window
    of 16 words. Equal hashes of different windows only make a document a suspect."""
    least = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
    grams = [windows(h, least) for h in hashes]
    owner = np.repeat(np.arange(len(hashes)), [len(g) for g in grams])
    if not len(owner):
        return np.zeros(len(hashes), bool)
    values = np.concatenate(grams) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(values)
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[owner[order][1:][same]] = True
    return out


def runs_of_documents(documents: list[list], hashes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, given as words and their hashes, in word numbers of the document."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    suspects = np.flatnonzero(_suspects(hashes)).tolist()
    while suspects:
        group, held = [], 0
        while suspects and (not group or held + len(documents[suspects[-1]]) <= TOGETHER):
            group.append(suspects.pop())
            held += len(documents[group[-1]])
        codes, offsets, used = [], [], 0
        base = 0
        for n in group:
            offsets.append(used)
            # The words themselves are numbered: hashes would have to be trusted.
            number: dict = {}
            own = [number.setdefault(w, len(number)) for w in documents[n]]
            codes.append(np.array([*own, len(number)], np.int64) + base)
            base += len(number) + 1
            used += len(own) + 1
        start, length, period = (x.tolist() for x in runs_of(np.concatenate(codes)))
        owner = (np.searchsorted(offsets, start, "right") - 1).tolist()
        for o, s, k, p in zip(owner, start, length, period):
            found[group[o]].append((s - offsets[o], k, p))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat the first period of a run."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


_RUN = "struct<start:long,length:long,period:long>"
_RUN_TYPE = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def periodic_runs(documents: DataFrame, arrangement: Arrangement | None = None) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row.

    ``runs`` are the stretches of consecutive words with smallest period q and at least 24 words and
    three periods that no word beside them extends, as (start, length, period) in word numbers from 0, by start and
    then period; ``best`` is the one with the most periods, null if there is none; ``collapsed`` is the
    text without words that lie in a run after its first q words, joined by one space.

    Words are what ASCII white space separates, unchanged. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Each row is taken for itself, repeated rows and null doc_ids
    included; whole texts are looked at, whatever their length. Other columns are ignored; an empty table gives no rows.
    ``arrangement`` puts each document's words in another order first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hash_memo()
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1)):
                own = ids[done : done + len(texts)]
                done += len(texts)
                words, hashes = [], []
                for doc_id, text in zip(own, texts):
                    words.append(ascii_words(text))
                    hashes.append(word_hashes(words[-1], memo))
                    order = arrangement(doc_id, len(words[-1])) if arrangement else None
                    if order is not None:
                        hashes[-1] = hashes[-1][order]
                        words[-1] = [words[-1][i] for i in order.tolist()]
                runs = runs_of_documents(words, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int64()),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(_RUN_TYPE)),
                        pa.array(
                            [b and dict(zip(("start", "length", "period"), b)) for b in map(strongest, runs)], _RUN_TYPE
                        ),
                        pa.array([b" ".join(collapsed(w, rs)) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    schema = f"doc_id long, n_words long, runs array<{_RUN}>, best {_RUN}, collapsed string"
    return doc_columns(documents).mapInArrow(run, schema)
