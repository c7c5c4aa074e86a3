"""Toxicity: maximum-scoring segments of word log-odds, calibrated by extreme-value statistics.

Tokens are words and, as languages inflect, word stems: the first 4 and the first 5 bytes.  Training counts, over a
bounded sample of labelled documents (equal texts once), in how many documents of each class each token occurs.  Tokens
that mark label 1 beyond chance, whatever its share, are candidates; the lexicon takes the most telling one, leaves
aside the documents that hold two chosen ones already, and goes on, so that what copies of a toxic text share by accident
is not learnt.  A
token's score is its log-odds with a Dirichlet prior in proportion to the whole (Monroe et al. 2008), a word's the
largest among its tokens, and words without a token score ``-drift``.  A linear scan (Ruzzo and Tompa
1999) finds all maximal segments of a text.  In texts of n words without toxic passages the best of them follows
1 - exp(-K n exp(-lambda S)) (Karlin and Altschul 1990); lambda solves the sum over word scores of p exp(lambda s) = 1 on
clean documents, and K is fitted to the segments found there.  Segments with a p-value below ``significant`` are passages.
A logistic curve through -log of the p-value and the passages' number turns this into a score.

Defined results: null and empty texts have no segment and get the score of a text without one; repeated rows are scored
alike; a null id is scored and has no fold (``held_out`` is null); of rows that repeat a labelled id one is learnt from; without labels of both classes the lexicon is empty and all scores are the share of label 1 (0.5 without any);
an empty table gives an empty table; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .shared import cut
from .textbytes import U, blocks, runs, span_hashes, words, LOWER

#: Letters, digits and all bytes beyond ASCII make up the words of the lexicon, so that "word," and "word" are one.
LETTERS = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


@dataclass
class Model:
    hashes: np.ndarray  # of the lexicon's words, sorted
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    curve: np.ndarray  # bias, weight of -log p, weight of log(1 + passages)
    significant: float


STEMS = (4, 5)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of words, and a row of token hashes per kind: the whole word, then its stems."""
    starts, ends, text = runs(LETTERS[data], offsets)
    low = LOWER[data]
    whole = span_hashes(low, starts, ends)
    stems = [np.where(ends - starts > k, span_hashes(low, starts, np.minimum(starts + k, ends)) ^ U(k), whole) for k in STEMS]
    return starts, ends, text, np.stack([whole, *stems])


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    ``at`` and ``score`` are the places and scores of its words that score above 0; all others score ``-drift``.  Each
    positive word is pushed with the cumulative sums before and after it; the stack is searched for the last segment
    with a smaller left sum, and segments are joined where the right sum exceeds it.  Every segment is joined once.
    """
    stack: list[list] = []  # [first, last, sum before, sum after]
    total, previous = 0.0, -1
    for place, own in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (place - previous - 1)
        new = [place, place, total, total + own]
        total += own
        previous = place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new.append(j)
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token hash, label, documents with it) of each batch."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        out = []
        for row, data, offsets in blocks(batch.column(0)):
            _, _, text, h = plain_words(data, offsets)
            order = np.lexsort((h.ravel(), np.tile(text, len(h))))
            own, token = np.tile(text, len(h))[order], h.ravel()[order]
            new = np.append(True, (own[1:] != own[:-1]) | (token[1:] != token[:-1])) if len(own) else np.zeros(0, bool)
            out.append(np.stack([token[new], label[row + own[new]].astype(U)]))
        token, mark = np.concatenate(out, axis=1) if out else np.zeros((2, 0), U)
        order = np.lexsort((mark, token))
        token, mark = token[order], mark[order]
        first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1]))) if len(token) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(token[first].view(np.int64)), pa.array(mark[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(token))))], names=["word", "label", "n"])


def _surplus(a, b, rate: float):
    """Nats by which a of a + b documents of label 1 exceed what the rate of label 1 explains (Chernoff bound)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.maximum(a + b, 1e-9)
    q = np.clip(a / n, 1e-12, 1 - 1e-12)
    return np.where(q > rate, n * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate))), 0.0)


def lexicon(rows: DataFrame, toxic: int, clean: int, prior: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of the tokens that mark label 1.  Candidates are tokens of the bounded sample ``rows``."""
    rate = toxic / (toxic + clean)
    n = rows.select("text", "label").mapInArrow(_counts, "word long, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    q = F.col("a") / (F.col("a") + F.col("b"))
    over = F.col("a") * F.log(q / rate) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - q) / (1 - rate))).otherwise(0.0)
    best = n.where((F.col("a") > 2) & (q > rate)).withColumn("over", over).where(F.col("over") >= least).select("word", "a", "b").collect()
    hashes = np.array([r["word"] for r in best], np.int64).view(U)
    order = np.argsort(hashes)
    hashes, a, b = hashes[order], np.array([r["a"] for r in best], float)[order], np.array([r["b"] for r in best], float)[order]
    if not len(hashes):
        return hashes, np.zeros(0)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates in each text."""
        for batch in batches:
            out = []
            for _, data, offsets in blocks(batch.column(0)):
                _, _, text, h = plain_words(data, offsets)
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                kind, at = np.nonzero(hashes[k] == h)
                for i in range(len(offsets) - 1):
                    own = text[at] == i
                    out.append(np.unique(k[kind[own], at[own]]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["own"])

    held = [np.array(r["own"], np.int64) for r in rows.where("label = 1").select("text").mapInArrow(holding, "own array<int>").collect()]
    doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
    token = np.concatenate(held) if held else np.zeros(0, np.int64)
    need = np.full(len(held), 2)
    chosen: list[int] = []
    while True:
        count = np.bincount(token[need[doc] > 0], minlength=len(hashes)).astype(float)
        over = _surplus(count, b, rate)
        over[chosen] = 0
        k = int(over.argmax())
        if over[k] < least:
            break
        chosen.append(k)
        need[doc[token == k]] -= 1
    chosen = np.sort(np.array(chosen, int))
    share = prior * (a[chosen] + b[chosen]) / (toxic + clean)
    x, y = a[chosen] + share, b[chosen] + share
    return hashes[chosen], np.log(x / (toxic + prior - x)) - np.log(y / (clean + prior - y))


def hits(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, number of words, places of lexicon words, their scores, starts and ends in bytes of all words) of every text."""
    none = np.zeros(0, np.int64)
    low = np.zeros(1 << 16, bool)
    low[(model.hashes >> U(48)).astype(np.int64)] = True
    for row, data, offsets in blocks(column):
        starts, ends, text, h = plain_words(data, offsets)
        n = np.bincount(text, minlength=len(offsets) - 1)
        first = np.append(0, np.cumsum(n))
        worth = np.zeros(len(text))
        for own in h:
            may = np.flatnonzero(low[(own >> U(48)).astype(np.int64)])
            if len(may):
                k = np.minimum(np.searchsorted(model.hashes, own[may]), len(model.hashes) - 1)
                sure = model.hashes[k] == own[may]
                worth[may[sure]] = np.maximum(worth[may[sure]], model.scores[k[sure]])
        found = np.flatnonzero(worth > 0)
        own = np.searchsorted(found, first)
        for i in range(len(n)):
            if own[i] < own[i + 1]:
                p = found[own[i] : own[i + 1]]
                yield row + i, int(n[i]), p - first[i], worth[p], starts[first[i] : first[i + 1]] - offsets[i], ends[first[i] : first[i + 1]] - offsets[i]
            else:
                yield row + i, int(n[i]), none, none, none, none


def tail(model: Model, n: int, s: float) -> float:
    """P-value of a segment score in a clean text of n words."""
    return float(-np.expm1(-model.k * max(n, 1) * np.exp(-model.lam * s)))


def _passages(batches_model: Model):
    model = batches_model

    def found(column: pa.Array) -> Iterator[tuple[int, float, list[tuple[int, int, float, float]]]]:
        """(row, smallest p-value, passages (first byte, byte after, segment score, p-value)) of every text."""
        for i, n, at, score, starts, ends in hits(column, model):
            best, own = 1.0, []
            for first, last, s in segments(at, score, model.drift):
                p = tail(model, n, s)
                best = min(best, p)
                if p < model.significant:
                    own.append((int(starts[first]), int(ends[last]), s, p))
            yield i, best, own

    return found


def _features(model: Model):
    found = _passages(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(-np.log(max(p, 1e-30)), float(np.log1p(len(own)))) for _, p, own in found(batch.column(0))]
            x = np.array(rows).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["x", "m", "label"])

    return of


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (p - y) + 1e-3 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, sample: int = 20_000, prior_share: float = 0.02, least: float = 10.0, drift: float = 0.05, significant: float = 0.05) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, those with the smallest hashes of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = known.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("_label_id"))
    # One text per labelled id, also where rows repeat it; so there are at most ``sample``.
    rows = cut(rows.groupBy("_label_id", "label").agg(F.min("text").alias("text")).select("text", "label").dropDuplicates(["text", "label"]), "toxic-sample")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    share = min(max(toxic / (toxic + clean), 1e-6), 1 - 1e-6) if size else 0.5
    model = Model(np.zeros(0, U), np.zeros(0), drift, 1.0, 0.1, np.array([np.log(share / (1 - share)), 0.0, 0.0]), significant)
    if not toxic or not clean:
        return model
    model.hashes, model.scores = lexicon(rows, toxic, clean, prior_share * (toxic + clean), least)
    if not len(model.hashes):
        return model

    def clean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words, best segment and lexicon words by score of clean texts."""
        for batch in batches:
            out = [(n, max((s for _, _, s in segments(at, score, model.drift)), default=0.0), len(at), float(score.sum())) for _, n, at, score, _, _ in hits(batch.column(0), model)]
            x = np.array(out, float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)], names=["n", "best", "hits", "sum"])

    of_clean = lambda: rows.where("label = 0").select("text").mapInArrow(clean_rows, "n double, best double, hits double, sum double").toPandas().to_numpy()
    x = of_clean()
    total, found = x[:, 0].sum(), x[:, 2].sum()
    # Words of clean texts: a share of lexicon words with their mean score, the rest with -drift.  At least one word in
    # a million counts as found, so that lambda exists.
    p = max(found / max(total, 1), 1e-6)
    s = x[:, 3].sum() / found if found else float(model.scores.mean())
    # Lambda exists only where the mean is below 0; frequent tokens can lift it, and then the drift grows with them.
    if p * s >= (1 - p) * drift and p < 1:
        model.drift = 2 * p * s / (1 - p)
        x = of_clean()
    low, high = 1e-6, 50.0 / s
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if p * np.exp(mid * s) + (1 - p) * np.exp(-mid * model.drift) < 1 else (low, mid)
    model.lam = low
    # K from the share of clean texts with a segment of at least the mean lexicon score: 1 - exp(-K n exp(-lambda s)).
    with_one = np.clip((x[:, 1] >= s).mean(), 0.5 / len(x), 0.99)
    model.k = float(-np.log1p(-with_one) * np.exp(model.lam * s) / max(x[:, 0].mean(), 1))
    f = rows.select("text", "label").mapInArrow(_features(model), "x double, m double, label int").toPandas().sort_values(["x", "m", "label"])
    model.curve = _curve(f[["x", "m"]].to_numpy(), f["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, score, and passages (first byte, byte after, segment score, p-value)."""
    found = _passages(model)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, passages array<struct<start:bigint,stop:bigint,segment:double,p:double>>"
    passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("segment", pa.float64()), ("p", pa.float64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, p, own in found(batch.column(1)):
                z = model.curve @ np.array([1.0, -np.log(max(p, 1e-30)), np.log1p(len(own))])
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                spans.append([dict(zip(("start", "stop", "segment", "p"), o, strict=True)) for o in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, passage)], names=[id_col, "score", "passages"])

    return docs.select(id_col, text_col).mapInArrow(of, schema)
