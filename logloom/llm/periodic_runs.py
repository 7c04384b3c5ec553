"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

The words of a batch of documents are sorted as suffixes by doubled prefixes; a
document's number is part of its words, so nothing is equal across documents.
Every place of the LCP array joins two neighbouring ranges of suffixes whose
common prefix has exactly its depth. The suffixes of the smaller range ask the
inverse array whether the suffix ``depth`` words on, or back, lies in the other
range: then a square of that half length stands there which can't be moved a
word to the right. Moved to the left as far as it goes, it is a run. No tree is
built, and by the smaller ranges there are at most n log n questions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import whole_text

LEAST = 6
POWER = 4
_BATCH = 1 << 17
_STEP = 1 << 21
_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth document, by its id's checksum, which word stands at each
    place of its periodic rewriting; a missing id leaves a text as it is."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _ranks(words: np.ndarray, owner: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4, ... words at each place, equal for equal
    strings, until all differ. Only what is still equal is sorted again. A word
    that a document has fewer times than a run has periods is in no run, and
    its places differ from the start."""
    n = len(words)
    keys = owner * (int(words.max()) + 1) + words
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    counts = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.where(np.repeat(counts >= POWER, counts), np.repeat(first, counts), np.arange(n))
    levels, alive, width = [rank], np.sort(order[np.repeat(counts >= POWER, counts)]), 1
    while len(alive):
        later = alive + width
        second = np.where(later < end[alive], rank[np.minimum(later, n - 1)], -1)
        order = np.argsort(rank[alive] * (n + 1) + second + 1)
        alive, second = alive[order], second[order]
        first = rank[alive]
        place = np.arange(len(alive))
        bucket = np.diff(first, prepend=-1) != 0
        part = bucket | (np.diff(second, prepend=-2) != 0)
        at = np.maximum.accumulate(np.where(part, place, 0))
        rank = rank.copy()
        rank[alive] = first + at - np.maximum.accumulate(np.where(bucket, place, 0))
        levels.append(rank)
        sizes = np.diff(np.flatnonzero(part), append=len(alive))
        alive = alive[np.repeat(sizes > 1, sizes)]
        width *= 2
    return levels


def _common(levels: list[np.ndarray], order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words each suffix shares with the one before it in ``order``; -1 for the first."""
    n = len(order)
    lcp = np.full(n, -1)
    lcp[1:] = 0
    k = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[k - 1], order[k]
    a_end, b_end = end[a], end[b]
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        same = (a < a_end) & (b < b_end) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a, b = a + (same << level), b + (same << level)
    lcp[k] = a - order[k - 1]
    return lcp


def _ranges(lcp: np.ndarray, k: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """For places ``k`` the ends of the ranges [left, k) and [k, right) whose
    suffixes have a common prefix of exactly ``lcp[k]`` words with each other."""
    n, mins = len(lcp), [lcp]
    while 1 << len(mins) <= widest:
        half = 1 << (len(mins) - 1)
        low = mins[-1].copy()
        low[: n - half] = np.minimum(low[: n - half], mins[-1][half:])
        mins.append(low)
    depth, left, right = lcp[k], k - 1, k + 1
    for level in range(len(mins) - 1, -1, -1):
        low, size = mins[level], 1 << level
        more = (left - size >= 0) & (low[np.maximum(left - size + 1, 0)] > depth)
        left = left - size * more
        more = (right + size <= n) & (low[np.minimum(right, n - 1)] >= depth)
        right = right + size * more
    return left, right


def periodic_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs in documents of ``sizes`` words that stand
    one after another in ``words``, sorted by start, then period."""
    empty = np.zeros(0, np.int64)
    if not len(words):
        return empty, empty, empty
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = (ends - sizes)[owner], ends[owner]
    levels = _ranks(words, owner, end)
    rank, order = levels[-1], np.empty(len(words), np.int64)
    order[rank] = np.arange(len(words))
    lcp = _common(levels, order, end)
    k = np.flatnonzero((lcp > 0) & (POWER * lcp <= (end - begin)[order]))
    widest = int(np.diff(np.flatnonzero(lcp <= 0), append=len(lcp)).max())
    left, right = _ranges(lcp, k, widest)
    depth = lcp[k]
    lesser = k - left <= right - k
    first, size = np.where(lesser, left, k), np.where(lesser, k - left, right - k)
    low, high = np.where(lesser, k, left), np.where(lesser, right, k)

    places, periods = [empty], [empty]
    asked = np.cumsum(size)
    cuts = np.searchsorted(asked, np.arange(_STEP, asked[-1] if len(asked) else 0, _STEP))
    for part in np.split(np.arange(len(k)), cuts):
        own = np.repeat(part, size[part])
        step = np.arange(len(own)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, d = order[first[own] + step], depth[own]
        for at, other in ((i, i + d), (i - d, i - d)):
            inside = (other >= begin[i]) & (other < end[i])
            found = rank[np.where(inside, other, 0)]
            found = inside & (found >= low[own]) & (found < high[own])
            places.append(at[found])
            periods.append(d[found])
    start, period = np.concatenate(places), np.concatenate(periods)
    stop, limit, later = start + 2 * period, begin[start], start + period
    for level in range(len(levels) - 1, -1, -1):
        back = start - (1 << level)
        same = (back >= limit) & (levels[level][np.maximum(back, 0)] == levels[level][np.maximum(later - (1 << level), 0)])
        start, later = start - (same << level), later - (same << level)
    long = stop - start >= np.maximum(LEAST, POWER * period)
    start, stop, period = start[long], stop[long], period[long]
    sort = np.lexsort((period, stop, start))
    start, stop, period = start[sort], stop[sort], period[sort]
    # Squares of several periods of a run end with it too; the least one is its period.
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0)
    start, stop, period = start[new], stop[new], period[new]
    sort = np.lexsort((period, start))
    return start[sort], stop[sort], period[sort]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """What is returned of a document, from its words and its (start, length, period)."""
    best = None
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
        if best is None or (more := length * best[2] - best[1] * period) > 0 or (not more and (start, period) < best[::2]):
            best = (start, length, period)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()] if runs else words
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    power = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *power, _digest(listed.encode()), _digest(b" ".join(kept))


def collapse_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per row of ``docs`` the periodic runs of its words: ``doc_id``, ``n_runs``,
    the run of the greatest power (``start``, ``length``, ``period``,
    ``exponent_milli``; nulls without one), and digests of all runs and of the
    words that stay when each run keeps its first period only.

    A run is a stretch of at least six words and four periods that can't be
    made longer. With ``plant`` the text of every tenth document is made
    periodic first. Ties of power go to the least start, then period. A missing
    text, and one without words, has no runs and an empty rest; a repeated row
    gives its result each time, an empty table none. Other columns are not read.
    Whole documents are worked on together, some 131,072 words at a time, or
    one longer document, so a task holds no more than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [part.split()[0] for part in _SCHEMA.split(", ")]

        def made(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
            sizes = np.array([len(words) for _, words in held], np.int64)
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for _, words in held for w in words]
            start, stop, period = periodic_runs(pd.factorize(flat)[0].astype(np.int64), sizes)
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(start, ends)
            rows, before = [], 0
            for (doc_id, words), cut, end in zip(held, cuts.tolist(), ends.tolist()):
                first = end - len(words)
                part = slice(before, cut)
                runs = zip((start[part] - first).tolist(), (stop - start)[part].tolist(), period[part].tolist())
                rows.append(_row(doc_id, words, list(runs)))
                before = cut
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_buffer().to_pybytes().split()
                if plant and (places := planted(doc_id, len(words))) is not None:
                    words = [words[i] for i in places.tolist()]
                held.append((doc_id, words))
                size += len(words)
                if size >= _BATCH:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, _SCHEMA)
