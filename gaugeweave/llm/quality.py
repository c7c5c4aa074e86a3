"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled documents; every path from a root is a conjunction of
comparisons, a rule.  A lasso logistic regression keeps few rules, which are compiled into one Spark column expression
over the statistics.  Statistics are counted over whole texts by Spark tasks.

Defined results: null and empty texts have all statistics 0 and get the score that the rules give for that; repeated
rows are scored alike; a null id is scored and has no fold (``held_out`` is null); of rows that repeat a labelled id one
is learnt from; without usable labels, or with labels of one kind only, every score is the share of label 1
(0.5 without any); an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import U, blocks, runs, span_hashes, tidy, words

STATS = ["words", "mean_word", "upper", "digits", "symbols", "pipes", "bangs", "non_ascii", "distinct_words", "top_word", "next_equal", "lines", "mean_line", "distinct_lines", "top_line"]

_BYTE = np.arange(256)
_KINDS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "symbols": np.isin(_BYTE, [ord(c) for c in "#$%&*+/<=>@[]^_`{|}~\\"]),
    "pipes": _BYTE == ord("|"),
    "bangs": _BYTE == ord("!"),
    "non_ascii": _BYTE >= 192,
}


def _variety(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different items, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        key = np.sort(text.astype(U) << U(40) | h >> U(24))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        own = (key[first] >> U(40)).astype(np.int64)
        distinct += np.bincount(own, minlength=n)
        there = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        top[own[there]] = np.maximum.reduceat(count, there)
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATS for every text, all of it counted."""
    out = [np.zeros((0, len(STATS)))]
    for _, data, offsets in blocks(column):
        n = len(offsets) - 1
        starts, ends, text, h = words(data, offsets)
        count = np.bincount(text, minlength=n)
        per = np.maximum(count, 1)
        chars = np.bincount(text, ends - starts, minlength=n)
        s = {"words": count, "mean_word": chars / per}
        for name, member in _KINDS.items():
            total = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
            s[name] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(chars, 1)
        distinct, top = _variety(text, h, n)
        s["distinct_words"], s["top_word"] = distinct / per, top / per
        same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        s["next_equal"] = np.bincount(text[1:][same], minlength=n) / per
        starts, ends, line = runs(data != 10, offsets)
        lines = np.bincount(line, minlength=n)
        distinct, top = _variety(line, span_hashes(data, starts, ends), n)
        s["lines"], s["mean_line"] = lines, count / np.maximum(lines, 1)
        s["distinct_lines"], s["top_line"] = distinct / np.maximum(lines, 1), top / np.maximum(lines, 1)
        out.append(np.stack([s[k] for k in STATS], axis=1).astype(float))
    return np.concatenate(out)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``_gw_stats``, a struct of STATS."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_gw_stats", T.StructType([T.StructField(k, T.DoubleType()) for k in STATS]))])
    place = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch.column(place))
            stats = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATS))], names=STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*batch.schema.names, "_gw_stats"])

    return docs.mapInArrow(tidy(add), schema)


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, step: np.ndarray, rules: list) -> None:
    """Grow one tree on binned columns; add the paths to ``rules`` and the leaves' values to ``step``."""
    best = (1e-6, None)
    if depth and len(rows) >= 40:
        g0, h0 = grad[rows].sum(), hess[rows].sum()
        for f, cut in enumerate(cuts):
            if len(cut):
                g = np.cumsum(np.bincount(x[rows, f], grad[rows], len(cut) + 1))[:-1]
                h = np.cumsum(np.bincount(x[rows, f], hess[rows], len(cut) + 1))[:-1]
                n = np.cumsum(np.bincount(x[rows, f], minlength=len(cut) + 1))[:-1]
                gain = g**2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0**2 / (h0 + 1)
                gain[(n < 20) | (len(rows) - n < 20)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
    if best[1] is None:
        step[rows] = -grad[rows].sum() / (hess[rows].sum() + 1)
        return
    f, k = best[1]
    low = x[rows, f] <= k
    for side, own in (("<=", rows[low]), (">", rows[~low])):
        longer = (*path, (f, side, float(cuts[f][k])))
        rules.append(longer)
        _grow(x, cuts, grad, hess, own, longer, depth - 1, step, rules)


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[tuple]:
    """The distinct paths of boosted trees: tuples of (statistic, "<=" or ">", threshold)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: list[tuple] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        _grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), (), depth, step, rules)
        z += rate * step
    return list(dict.fromkeys(rules))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, side, cut in rule:
        out &= x[:, f] <= cut if side == "<=" else x[:, f] > cut
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the intercept is free."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / max(1e-9, np.linalg.norm(a @ v) ** 2)
    w = ahead = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / n
        new = ahead - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and weighted rules."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    rules = boosted_rules(x, y)
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    bias, weights = lasso(r, y, penalty)
    return bias, [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def compiled(model: tuple[float, list[tuple[tuple, float]]], stats: str = "_gw_stats") -> Column:
    """The model as one Spark expression with values from 0 to 1."""
    bias, rules = model
    z = F.lit(bias)
    for rule, weight in rules:
        when = F.lit(True)
        for f, side, cut in rule:
            value = F.col(f"{stats}.{STATS[f]}")
            when &= (value <= cut) if side == "<=" else (value > cut)
        z += F.when(when, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, sample: int = 20_000):
    """Fit on at most ``sample`` labelled documents that are not held out, those with the smallest hashes of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = known.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    picked = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("_label_id")).select(text_col, "_label_id", "_label")
    # One row per labelled id, also where rows repeat it; so there are at most ``sample``.
    one = with_statistics(picked, text_col).groupBy("_label_id", "_label").agg(F.min("_gw_stats").alias("_s"))
    rows = one.select("_label", *[F.col(f"_s.{k}").alias(k) for k in STATS]).toPandas().sort_values([*STATS, "_label"])
    return fit(rows[STATS].to_numpy(float), rows["_label"].to_numpy(float))


def scored(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``_gw_score``."""
    return with_statistics(docs, text_col).withColumn("_gw_score", compiled(model)).drop("_gw_stats")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return scored(docs, train(docs, labels, id_col, text_col, **options), text_col).where(F.col("_gw_score") >= threshold).select(*docs.columns)
