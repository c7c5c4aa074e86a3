"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit.

Token counts are whole numbers up to the capacity, so an instance is its histogram: at most ``capacity`` counts, however
many documents there are.  The driver plans on the histogram alone: sets of lengths that provably dominate every
alternative are fixed, the rest is packed best-fit by falling length.  A plan is a list of patterns with multiplicities,
turned into intervals "pieces of length L with ranks a..b go to sequences s.. at offset o".  Ranks within a length are
found by Spark without a window over a length, and each piece looks its interval up.

Defined results: null and empty texts are the end token alone; repeated rows are documents of their own; an empty table
gives an empty table; texts of any length are cut into whole-capacity pieces after a first, shorter one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, rank_within
from .textbytes import blocks, span_hashes, tidy

#: The end-of-document id of the contract, and the special string that the vocabulary file itself maps to an id.
END_ID, SPECIAL = 2, "<|endoftext|>"

#: Bytes of text whose distinct pre-tokens are encoded together.
TOGETHER = 2 << 20

#: Classes of characters: letter, number, white space; all else is 0.
LETTER, NUMBER, SPACE = 1, 2, 3

_loaded: dict[tuple, tuple] = {}


def _classes() -> np.ndarray:
    """Class of every code point."""
    import unicodedata

    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    out = np.where(first == ord("L"), LETTER, np.where(first == ord("N"), NUMBER, 0)).astype(np.uint8)
    # The code points with the White_Space property.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


class _Whole:
    """The tokenizer itself, loaded when a text first needs it: few workers meet one with the special string."""

    def __init__(self, path: str) -> None:
        self.path, self.of = path, None

    def encode(self, text: str, **options):
        if self.of is None:
            from tokenizers import Tokenizer

            self.of = Tokenizer.from_file(self.path)
        return self.of.encode(text, **options)


def _tools(tokenizer: str, ranks: str) -> tuple:
    """Class table, encoder of plain words, and the tokenizer itself for texts that hold its special string."""
    if (tokenizer, ranks) not in _loaded:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        # Fixed value: the byte-level BPE's published way of splitting a text into words.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _loaded[tokenizer, ranks] = _classes(), tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={}), _Whole(tokenizer)
    return _loaded[tokenizer, ranks]


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the pre-tokens and whether they are white space, as the published pattern splits them.

    Runs of letters, numbers or other characters take one space before them along; of a longer run of white space only
    its last character can be such a space; an apostrophe that opens a pre-token takes s, t, m, d, re, ve or ll along.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    code = b[at].astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        long = np.flatnonzero((b[at] >= low) & (b[at] < high))
        value = code[long] & mask
        for k in range(1, more + 1):
            value = value << 6 | (b[at[long] + k] & 0x3F)
        code[long] = value
    kind = classes[code]
    n = len(at)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, offsets)] = True  # first characters of texts, and the end
    starts = head[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    starts[last] = True
    starts[last[code[last] == 0x20] + 1] = False
    quote = np.flatnonzero(starts[:-1] & (code[:-1] == 0x27) & ~head[1:n]) if n else np.zeros(0, int)
    one = code[np.minimum(quote + 1, n - 1)]
    two = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ~short & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for own, size in ((quote[short], 1), (quote[long], 2)):
        starts[own + 1] = False
        after = own + 1 + size
        starts[after[after < n]] = True
    first = at[starts]
    ends = np.append(first[1:], len(data))
    own = np.flatnonzero(starts)
    blank = (kind[own] == SPACE) & ((np.append(own[1:], n) - own == 1) | (kind[np.minimum(own + 1, n - 1)] == SPACE))
    return first, ends, np.searchsorted(offsets, first, side="right") - 1, blank


def encode(column: pa.Array, tokenizer: str, ranks: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text: each distinct pre-token of about TOGETHER bytes is encoded once."""
    classes, plain, whole = _tools(tokenizer, ranks)
    newline = plain.encode_ordinary("\n")[0]

    def done(group: list) -> Iterator[tuple[int, np.ndarray]]:
        hashes = np.concatenate([g[4] for g in group])
        base = np.cumsum([0, *(len(g[4]) for g in group)])
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        block = np.searchsorted(base, first, side="right") - 1
        joined, order, odd = [], [], []
        for k, g in enumerate(group):
            mine = np.flatnonzero(block == k)
            own = first[mine] - base[k]
            starts, ends, blank = g[2][own], g[3][own], g[7][own]
            odd += [(i, g[5][lo:hi].tobytes().decode()) for i, lo, hi in zip(mine[blank].tolist(), starts[blank].tolist(), ends[blank].tolist(), strict=True)]
            starts, size = starts[~blank], (ends - starts)[~blank]
            order.append(mine[~blank])
            stop = np.cumsum(size + 1)  # each word and a line end
            out = np.full(stop[-1] if len(stop) else 0, 10, np.uint8)
            to = np.ones(len(out), bool)
            to[stop - 1] = False
            out[to] = g[5][np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            joined.append(out)
        # One call for all: between words a line end is a pre-token of its own.  White space goes by itself.
        order = np.concatenate(order)
        ids = np.array(plain.encode_ordinary(np.concatenate(joined)[:-1].tobytes().decode()), np.uint32) if len(order) else np.zeros(0, np.uint32)
        stops = np.append(np.flatnonzero(ids == newline), len(ids))[: len(order)]
        begin = np.append(0, stops + 1)[: len(order)]
        at, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at[order], size[order] = begin, stops - begin
        pool, end = [ids], len(ids)
        for i, word in odd:
            own = np.array(plain.encode_ordinary(word), np.uint32)
            at[i], size[i] = end, len(own)
            pool.append(own)
            end += len(own)
        pool = np.concatenate(pool)
        for k, (row, offsets, _, _, _, _, text, _) in enumerate(group):
            w = which[base[k] : base[k + 1]]
            n = size[w]
            stop = np.cumsum(n)
            out = pool[np.repeat(at[w] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
            bounds = np.append(0, stop)[np.searchsorted(text, np.arange(len(offsets)))]
            for i in range(len(offsets) - 1):
                yield row + i, out[bounds[i] : bounds[i + 1]]

    group, held = [], 0
    special = {i for i, x in enumerate(pc.match_substring(column, SPECIAL).to_pylist()) if x}
    for row, data, offsets in blocks(column):
        starts, ends, text, blank = pre_tokens(data, offsets, classes)
        group.append((row, offsets, starts, ends, span_hashes(data, starts, ends), data, text, blank))
        held += len(data)
        if held >= TOGETHER or row + len(offsets) - 1 == len(column):
            for i, ids in done(group):
                yield i, np.array(whole.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32) if i in special else ids
            group, held = [], 0


PIECES = "{id} {type}, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, tokenizer: str, ranks: str, capacity: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece; with ``keep_ids`` also ``ids``, the tokens themselves."""
    schema = PIECES.format(id=f"`{id_col}`", type=dict(docs.dtypes)[id_col]) + (", ids array<int>" if keep_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in encode(batch.column(1), tokenizer, ranks):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                at, n = 0, len(ids)
                for k in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    row.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(ids[at : at + size]))
                    if keep_ids:
                        kept.append(ids[at : at + size].astype(np.int32))
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(id_col, text_col).mapInArrow(tidy(pieces), schema)


def _sums_of_two_or_more(sizes: list[int], capacity: int) -> int:
    """Bits of the sums up to ``capacity`` that two or more of the sizes, each as often as wanted, can make."""
    mask = (1 << (capacity + 1)) - 1
    one = 0
    for s in sizes:
        one |= 1 << s
    made = 0
    fresh = one
    while fresh:
        more = 0
        for s in sizes:
            more |= fresh << s
        fresh = more & mask & ~made
        made |= fresh
    return made


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) with multiplicities that use up the histogram.

    Reduction: for a length L with room R = capacity - L beside it, a partner of length R, or the largest partner p <= R
    when no two or more lengths that are left can sum to more than p within R, dominates every other filling: any of those
    could change places with the partner.  Where nothing fits beside L, L alone dominates.
    """
    left = [0] * (capacity + 1)
    for size, n in histogram.items():
        left[size] += n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        if times:
            patterns.append((pattern, times))
            for size in pattern:
                left[size] -= times

    changed = True
    while changed:
        changed = False
        sizes = [s for s in range(1, capacity + 1) if left[s]]
        sums = _sums_of_two_or_more(sizes, capacity)
        there = sum(1 << s for s in sizes)  # bit s: length s is left
        for size in reversed(sizes):
            while left[size]:
                room = capacity - size
                others = there & ~(1 << size) if left[size] == 1 else there
                best = max(0, (others & ((1 << (room + 1)) - 1)).bit_length() - 1)
                between = best < room and sums >> (best + 1) & ((1 << (room - best)) - 1)
                if best < room and between:
                    break
                pattern = (size, best) if best else (size,)
                fix(pattern, left[size] // 2 if best == size else min(left[size], left[best]) if best else left[size])
                there &= ~sum(1 << s for s in set(pattern) if not left[s])
                changed = True
    # Best fit by falling length, whole classes of equal bins at a time.
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity, 0, -1):
        n = left[size]
        while n:
            room = next((r for r in range(size, capacity) if bins.get(r)), None)
            if room is None:
                room, pattern, times = capacity, (), -(-n // (capacity // size))
            else:
                pattern, times = bins[room].pop()
            each = room // size
            whole = min(times, n // each)
            for fill, k in ((each, whole), (n - whole * each if whole < times and n < each * times else 0, 1)):
                if fill and k:
                    bins.setdefault(room - fill * size, []).append((pattern + (size,) * fill, k))
                    n -= fill * k
                    times -= k
            if times and pattern:
                bins.setdefault(room, []).append((pattern, times))
    return patterns + [x for own in bins.values() for x in own]


def intervals(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length goes to sequence first + r - first rank."""
    used = [0] * (capacity + 1)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    ``tokenizer`` is the vocabulary's tokenizers file, ``ranks`` the same vocabulary as tiktoken ranks, which encode
    single words several times faster.
    """
    pieces = cut(tokenized(docs, tokenizer, ranks, capacity, id_col, text_col, keep_ids), "pieces", texts=True)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = intervals(plan(histogram, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    place = "sequence_id long, offset long"

    @F.pandas_udf(place)
    def placed(length, rank):
        import pandas as pd

        t = shared.value
        wide = np.int64(1) << 50
        at = np.searchsorted(t[:, 0] * wide + t[:, 1], length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64) - 1, side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 2] + rank.to_numpy() - 1 - t[at, 1], "offset": t[at, 3]})

    ranked = rank_within(pieces, "length", [id_col, "piece"], "piece-order").withColumn("_at", placed("length", "_rank"))
    return ranked.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
