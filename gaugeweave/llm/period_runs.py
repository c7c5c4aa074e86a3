"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words in which words ``q`` apart are equal (``q`` its smallest period) and which no
neighbouring word extends.  For every power of two L the dictionary names each stretch of L words that occurs more than
once in its text.  Where a name's successive occurrences lie q words apart twice in a row, with L / 2 < q <= L, they are
an arithmetic progression that proposes q.  Inside a run of at least 4 periods the nearest next occurrence of L >= q
words is exactly q words on, and 2 * q + L words fit, so each such run is proposed by its first words, and by no smaller
or larger period.  Proposals are extended both ways by the dictionary, halving the step, and those of one run are one.

A stretch that occurs once has no name and no longer stretch holding it has one, so ordinary prose is done after few
lengths.  Texts are worked on one by one inside Spark tasks, as many at a time as a batch holds.

Defined results: null and empty texts, or texts without words, have no run and collapse to the empty string; rows that
repeat or lack an id are worked on as they are; an empty table gives an empty table; further columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import tidy

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list) -> np.ndarray:
    """Equal words get equal numbers: the place of the first of them."""
    first: dict = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def repeated_names(keys: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """An array of ``n`` names, equal for equal keys at the places ``where``; -1 elsewhere and for keys that occur once."""
    names = np.full(n, -1, np.int64)
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[name] > 1
    names[where[again]] = name[again]
    return names


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """For L = 1, 2, 4, ... the names of all stretches of L words, while any occurs twice."""
    levels, names = [], repeated_names(words, np.arange(len(words)), len(words))
    while (names >= 0).any():
        levels.append(names)
        size = 1 << (len(levels) - 1)
        if len(words) < 2 * size:
            break
        left, right = names[:-size], names[size:]
        both = np.flatnonzero((left >= 0) & (right >= 0))
        names = repeated_names(left[both] * (len(words) + 1) + right[both], both, len(words) - 2 * size + 1)
    return levels


def proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): where a progression of three occurrences starts; of neighbours with one period only the first."""
    where = np.flatnonzero(names >= 0)
    where = where[np.argsort(names[where], kind="stable")]
    step = np.diff(where)
    near = (names[where[1:]] == names[where[:-1]]) & (2 * step > size) & (step <= size)
    period = np.zeros(len(names), np.int64)
    period[where[:-1][near]] = step[near]
    start = np.flatnonzero(period)
    start = start[period[start + period[start]] == period[start]]
    going = np.zeros(len(names), np.int64)
    going[start] = period[start]
    start = start[(start == 0) | (going[start - 1] != going[start])]
    return start, period[start]


def extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs around proposals: words equal those a period on, as far as possible both ways."""
    low, high = at.copy(), at.copy()
    for k in reversed(range(len(levels))):
        names, size = levels[k], 1 << k
        for up in (True, False):
            here = high if up else low - size
            fits = np.flatnonzero((here >= 0) & (here + period + size <= n))
            a = names[here[fits]]
            same = fits[(a >= 0) & (a == names[here[fits] + period[fits]])]
            if up:
                high[same] += size
            else:
                low[same] -= size
    return low, high + period - low


def runs_of(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` words and ``times`` periods, by start, then period."""
    levels = basic_factors(words)
    found = [proposals(names, 1 << k) for k, names in enumerate(levels)]
    at, period = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
    start, length = extended(levels, at, period, len(words))
    rows = np.stack([start, length, period], axis=1)[length >= np.maximum(least, times * period)]
    return np.unique(rows, axis=0)[:, :] if len(rows) else rows


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: all of it after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per document: its id, n_words, runs (array of start, length, period, in words from 0), and collapsed.

    ``collapsed`` holds the words that no run repeats, joined by one space.  Words are maximal stretches of characters other
    than \\x20 and \\x09-\\x0D.  ``times`` must be at least 4: shorter runs may not be proposed.
    """
    if times < 4:
        raise ValueError("times must be at least 4")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, left = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                rows = runs_of(numbered(words), least, times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()])
                left.append(b" ".join(kept_words(words, rows)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.string())], names=["_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(tidy(step), f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)
