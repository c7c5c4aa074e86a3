"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over hashed byte n-grams says which half of the
languages a text belongs to: its weights are the log-ratios of the n-gram frequencies of the two halves, counted by
Spark over a bounded sample of labelled texts.  Decoding compares the bits' margins with every codeword by exponential
loss, weighted by each bit's reliability on the sample; the codeword with the least loss wins, and a runner-up that is
almost as near makes the text ambiguous.

Defined results: null texts and texts without a letter are ``und`` with score 0; a table without usable labels makes
every text ``und``; repeated rows are treated alike; an empty table gives an empty table; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out
from .shared import cut
from .textbytes import LOWER, blocks

SLOTS = 1 << 13
UNKNOWN = "und"

#: Bytes that stay apart in n-grams; everything else (digits, marks, white space) reads as one space.
_LETTER = np.array([(chr(c).isalpha() and c < 128) or c >= 128 for c in range(256)])
_READ = np.where(_LETTER, LOWER, 32).astype(np.uint32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # SLOTS x bits
    scale: np.ndarray  # bits: makes the mean margin of the sample 1
    trust: np.ndarray  # bits: weight of the loss
    ambiguous: float


def codewords(n: int) -> np.ndarray:
    """A matrix of 1 and -1 with a row per language: all different halvings for up to 5, else fixed random ones."""
    if n <= 5:
        bits = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 2 ** max(n - 1, 1))]
        return np.array(bits, float).T.reshape(n, -1) if n > 1 else np.ones((1, 1))
    m = max(15, int(np.ceil(10 * np.log2(n))))
    best, least = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, m)) < 0.5, 1.0, -1.0)
        far = ((m - code @ code.T) / 2 + m * np.eye(n)).min()
        if far > least and (np.abs(code.sum(axis=0)) < n).all():
            best, least = code, far
    return best


def histograms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram counts, whether an ASCII letter occurs) of a few texts at a time; grams of 1, 2 and 3 bytes."""
    for row, data, offsets in blocks(column, 1 << 20):
        n = len(offsets) - 1
        b = _READ[data]
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) else np.zeros(0, int)
        b[upper] += 32  # accented capitals
        two, three = b.copy(), b.copy()
        two[1:] += b[:-1] << 8
        three[1:] += b[:-1] << 8
        three[2:] += b[:-2] << 16
        grams = [((x * np.uint32(0x9E3779B1) ^ np.uint32(seed)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13) for x, seed in ((b, 1), (two, 2), (three, 3))]
        ascii_letter = _LETTER & (np.arange(256) < 128)
        there = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        letter = there[offsets[1:]] > there[offsets[:-1]]
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            out = np.zeros((hi - lo, SLOTS), np.float32)
            for i in range(lo, hi):
                first, last = offsets[i], offsets[i + 1]
                if last > first:
                    own = np.bincount(grams[2][first + 2 : last], minlength=SLOTS) + np.bincount(grams[1][first + 1 : last], minlength=SLOTS)
                    out[i - lo] = own + np.bincount(grams[0][first:last], minlength=SLOTS)
            yield row + lo, out, letter[lo:hi]


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, slot, share) sums of each batch: every text counts once, by its shares."""
    for batch in batches:
        names, which = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        total = np.zeros((len(names), SLOTS))
        for row, counts, _ in histograms(batch.column(0)):
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            np.add.at(total, which[row : row + len(share)], share)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["lang", "shares"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, per_language: int = 3000, ambiguous: float = 0.6) -> Model:
    """Fit on about ``per_language`` labelled documents of each language, drawn by the hash of their id, held-out ones left out.

    Every labelled language gets a codeword; the model, and what reaches the driver, grows with their number alone.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((SLOTS, 1)), np.ones(1), np.ones(1), ambiguous)
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, share double")
    picked = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    picked = cut(picked.select("text", "lang"), "language-sample")
    rows = picked.mapInArrow(_language_counts, "lang string, shares array<double>").select("lang", F.posexplode("shares").alias("slot", "share"))
    sums = rows.groupBy("lang", "slot").agg(F.sum("share").alias("share")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("slot", "share"))).alias("s")).select("lang", F.transform("s", lambda x: x["share"]).alias("shares")).collect()
    by = {r["lang"]: np.array(r["shares"]) for r in sums}
    languages = [x for x in languages if x in by]
    p = np.stack([by[x] for x in languages])
    p = (p + 1e-6 * p.sum(axis=1, keepdims=True).clip(1e-9)) / (p.sum(axis=1, keepdims=True).clip(1e-9) * (1 + 1e-6 * SLOTS))
    code = codewords(len(languages))
    halves = [((code == side).T @ p) / np.maximum((code == side).sum(axis=0), 1)[:, None] for side in (1, -1)]
    weights = (np.log(halves[0] + 1e-9) - np.log(halves[1] + 1e-9)).T
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]), ambiguous)
    index = {x: i for i, x in enumerate(languages)}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bit: texts, sum of signed margins, wrong bits."""
        for batch in batches:
            lang = [index.get(x) for x in batch.column(1).to_pylist()]
            n, total, wrong = 0, np.zeros(code.shape[1]), np.zeros(code.shape[1])
            for row, counts, _ in histograms(batch.column(0)):
                size = counts.sum(axis=1, keepdims=True)
                ok = [i for i in range(len(counts)) if size[i] > 0 and lang[row + i] is not None]
                m = (counts[ok] / size[ok]) @ weights * code[[lang[row + i] for i in ok]]
                n, total, wrong = n + len(ok), total + m.sum(axis=0), wrong + (m <= 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([total.tolist()]), pa.array([wrong.tolist()])], names=["n", "total", "wrong"])

    seen = picked.mapInArrow(margins, "n double, total array<double>, wrong array<double>")
    bits = seen.select("n", F.posexplode(F.arrays_zip("total", "wrong")).alias("bit", "x")).groupBy("bit").agg(F.sum("n").alias("n"), F.sum("x.total").alias("total"), F.sum("x.wrong").alias("wrong")).orderBy("bit").collect()
    n = np.maximum([r["n"] for r in bits], 1)
    error = (np.array([r["wrong"] for r in bits]) + 1) / (n + 2)
    model.scale = 1 / np.maximum(np.array([r["total"] for r in bits]) / n, 1e-9)
    model.trust = np.maximum(np.log((1 - error) / error), 0.05)
    return model


def decode(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share of the certainty, and that of the runner-up."""
    size = counts.sum(axis=1, keepdims=True)
    margin = np.clip((counts / np.maximum(size, 1)) @ model.weights * model.scale, -4, 4)
    loss = (model.trust * np.exp(-model.code[None, :, :] * margin[:, None, :])).sum(axis=2) / model.trust.sum()
    sure = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    sure /= sure.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    at = np.arange(len(best))
    top = sure[at, best]
    sure[at, best] = 0
    return best, top, sure.max(axis=1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, lang_pred, score, ambiguous."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, ambiguous boolean"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, unsure = [], [], []
            for row, counts, letter in histograms(batch.column(1)):
                best, top, second = decode(model, counts) if model.languages else (None, None, None)
                for i in range(len(counts)):
                    if model.languages and (letter[i] or any(c.isalpha() for c in batch.column(1)[row + i].as_py() or "")):
                        names.append(model.languages[best[i]]), scores.append(float(top[i])), unsure.append(bool(second[i] > model.ambiguous * top[i]))
                    else:
                        names.append(UNKNOWN), scores.append(0.0), unsure.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=[id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(of, schema)
