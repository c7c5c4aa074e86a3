"""Near duplicates of embeddings by lattice hashing.

In each of several tables a vector is projected at random to blocks of 8 dimensions, each decoded to the nearest point of
the lattice E8; the points together are the bucket of the table.  A vector also probes the buckets that it would fall
into if one block went to a neighbouring lattice point, nearest first.  Pairs that meet are checked by cosine in double
precision, block by block with matrix products; nothing below the threshold passes.

Equal vectors (by all 256 bits of a digest) are one class from the start, so copies cost one vector.  Large buckets are
cut into blocks of rows and joined block by block, on as many tasks.  A pair counts in the first bucket where it meets and
in no other, so tasks return a count and one link per vector instead of pairs.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows link as copies do, with the row count as their number; rows that repeat an id
with different vectors are vectors of their own under one id; a null id links with nothing and gets a null component; an empty table gives an empty table; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, forget
from .textbytes import U, mix, stream


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    whole = [[(s if k == i else t if k == j else 0) for k in range(8)] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [[-0.5 if m >> k & 1 else 0.5 for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(whole + half, float)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum: round, and where the sum is odd, round the worst the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    gap = x[odd] - f[odd]
    worst = np.abs(gap).argmax(axis=1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Buckets:
    """The buckets of vectors: own lattice points and probed neighbours, as 64-bit keys that hold their table's number."""

    def __init__(self, tables: int, parts: int, probes: int, scale: float):
        self.tables, self.parts, self.probes, self.scale = tables, parts, probes, scale
        self.around, self.factor = e8_neighbours(), stream(51, 8 * parts)
        self.shift = np.stack([(self._code(self.around) * self.factor[8 * k : 8 * k + 8]).sum(axis=1, dtype=U) for k in range(parts)]).ravel()

    @staticmethod
    def _code(q: np.ndarray) -> np.ndarray:
        return (2 * q).astype(np.int64).astype(U)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors, for every table: a number of the own lattice point, and which neighbours are probed."""
        own, near = np.zeros((len(x), self.tables), U), np.zeros((len(x), self.tables, self.probes), np.uint16)
        for t in range(self.tables):
            r = np.random.default_rng([97, t, x.shape[1]]).standard_normal((x.shape[1], 8 * self.parts)) * self.scale
            y = (x @ r).reshape(len(x) * self.parts, 8)
            p = e8(y)
            own[:, t] = (self._code(p).reshape(len(x), 8 * self.parts) * self.factor).sum(axis=1, dtype=U)
            gain = ((y - p) @ self.around.T).reshape(len(x), self.parts * 240)
            near[:, t] = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
        return own, near

    def keys(self, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the own bucket's key, then the probed ones."""
        all_of = mix(np.concatenate([own[:, :, None], own[:, :, None] + self.shift[near]], axis=2) + stream(52, self.tables)[:, None])
        bits = U((self.tables - 1).bit_length())
        return all_of >> bits << bits | np.arange(self.tables, dtype=U)[:, None]


def _hasher(buckets: Buckets):
    """Adds to (_node, _size, _x) the keys of a vector's buckets and, as bytes, the places that give them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2)
            n, width = len(values), values.value_lengths().to_numpy(zero_copy_only=False)
            flat, first = values.flatten().to_numpy(zero_copy_only=False).astype(float), np.append(0, np.cumsum(width))
            own, near = np.zeros((n, buckets.tables), U), np.zeros((n, buckets.tables, buckets.probes), np.uint16)
            for d in np.unique(width):
                rows = np.flatnonzero(width == d)
                own[rows], near[rows] = buckets.places(unit(flat[first[rows][:, None] + np.arange(d)]))
            keys = buckets.keys(own, near).reshape(n, -1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel().view(np.int64)))
            places = pa.array([a.tobytes() + b.tobytes() for a, b in zip(own, near, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, places], names=["_node", "_size", "_x", "_keys", "_places"])

    return of


class Links:
    """Counts of a task's links, each in the first bucket alone where its ends meet, and stars that join what they join."""

    #: Pairs looked at together.
    CHUNK = 200_000

    def __init__(self, keys: np.ndarray, size: np.ndarray):
        self.keys, self.size = keys, size
        self.up, self.others = np.arange(len(size)), np.zeros(len(size), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, key: int) -> None:
        """Pairs of vectors at the threshold that meet in the bucket ``key``."""
        for k in range(0, len(a), self.CHUNK):
            x, y = a[k : k + self.CHUNK], b[k : k + self.CHUNK]
            self.held.append((x, y, np.full(len(x), key, U)))
            self.n += len(x)
            if self.n >= self.CHUNK:
                self.flush()

    def flush(self) -> None:
        if self.n:
            a, b, key = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.n = [], 0
            a, b, key = (c[a != b] for c in (a, b, key))
            for t in range(self.keys.shape[1]):
                x, y = self.keys[a, t], self.keys[b, t]
                before = ((x[:, :1] == y).any(axis=1) & (x[:, 0] < key)) | ((y[:, :1] == x).any(axis=1) & (y[:, 0] < key))
                a, b, key = a[~before], b[~before], key[~before]
            np.add.at(self.others, a, self.size[b])
            np.add.at(self.others, b, self.size[a])
            self.join(a, b)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger of two roots below the smaller, all pairs at once, until all ends have one root."""
        up = self.up
        while True:
            x, y = up[a], up[b]
            if (x == y).all():
                break
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (up[up] != up).any():
                up = up[up]
        self.up = up


def _linked(threshold: float, buckets: Buckets):
    """(_a, _b, _others) for each vector with links counted in this task: one that links join it to, and what it links with."""

    def of(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("_j", "_i", "_key")])
        key, i, j, part, node = (table[c].to_numpy()[order] for c in ("_key", "_i", "_j", "_part", "_node"))
        home = table["_home"].to_numpy(zero_copy_only=False)[order]
        values = table["_x"].combine_chunks()
        width = values.value_lengths().to_numpy(zero_copy_only=False)
        flat, first = values.flatten().to_numpy(zero_copy_only=False).astype(float), np.append(0, np.cumsum(width))[order]
        width = width[order]

        names, one, who = np.unique(node, return_index=True, return_inverse=True)
        places = table["_places"].combine_chunks().take(pa.array(order[one]))
        raw = np.frombuffer(b"".join(places.to_pylist()), np.uint8).reshape(len(names), -1)
        own = np.ascontiguousarray(raw[:, : 8 * buckets.tables]).view(U)
        near = np.ascontiguousarray(raw[:, 8 * buckets.tables :]).view(np.uint16).reshape(len(names), buckets.tables, buckets.probes)
        links = Links(buckets.keys(own, near), table["_size"].to_numpy()[order][one])

        for d in np.unique(width):
            rows = np.flatnonzero(width == d)
            x = unit(flat[first[rows][:, None] + np.arange(d)])
            k, left, right = key[rows], i[rows], j[rows]
            edge = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(rows)).tolist(), strict=True):
                h, w = home[rows[lo:hi]], who[rows[lo:hi]]
                if left[lo] == right[lo]:
                    p, q = np.nonzero(np.triu((x[lo:hi] @ x[lo:hi].T >= threshold) & (h[:, None] | h), 1))
                    a, b = w[p], w[q]
                else:
                    s = part[rows[lo:hi]] == left[lo]
                    p, q = np.nonzero((x[lo:hi][s] @ x[lo:hi][~s].T >= threshold) & (h[s][:, None] | h[~s]))
                    a, b = w[s][p], w[~s][q]
                if len(a):
                    links.add(a, b, k[lo : lo + 1].view(U)[0])
        links.flush()
        have = np.flatnonzero(links.others)
        return pa.table({"_a": pa.array(names[have], pa.int64()), "_b": pa.array(names[links.up[have]], pa.int64()), "_others": pa.array(links.others[have], pa.int64())})

    return of


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = 10, parts: int = 2, probes: int = 10, scale: float = 0.5, block: int = 1024, per_task: int = 20_000) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept.  Ids are whole numbers."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    own_type = "array<float>" if single else "array<double>"
    v = F.col("_x").cast("array<double>")
    plain = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast(own_type).alias("_x"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0) & F.col("_id").isNotNull()
    digest = F.when(usable, F.unhex(F.sha2(F.to_json(F.struct("_x")), 256)))
    marked = cut(plain.select("_id", digest.alias("_digest"), F.when(usable, F.col("_x")).alias("_x")), "vectors")
    alike = marked.where("_digest is not null").groupBy("_digest").agg(F.min("_id").alias("_rep"), F.count("*").alias("_size"), F.first("_x").alias("_x"))
    classes = cut(alike.withColumn("_node", F.monotonically_increasing_id()), "vector-classes")  # numbers are written once
    buckets = Buckets(tables, parts, probes, scale)
    hashed = classes.select("_node", "_size", "_x").mapInArrow(_hasher(buckets), f"_node long, _size long, _x {own_type}, _keys array<long>, _places binary")
    hashed = cut(hashed, "vector-keys")
    rows = hashed.select("_node", F.posexplode("_keys").alias("_at", "_key")).select("_node", "_key", (F.col("_at") % (probes + 1) == 0).alias("_home"))
    met = rows.groupBy("_key").agg(F.count("*").alias("_m"), F.max("_home").alias("_any")).where("_m > 1 and _any")
    shared = rows.join(met.select("_key", "_m"), "_key").withColumn("_n", F.ceil(F.col("_m") / block))
    shared = shared.withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_n")))
    shared = shared.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    shared = shared.select("_node", "_key", "_home", "_part", F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j"))
    shared = cut(shared, "vector-buckets")
    tasks = max(1, -(-shared.count() // per_task))
    joined = shared.join(hashed.drop("_keys"), "_node").withColumn("_task", F.pmod(F.xxhash64("_key", "_i", "_j"), F.lit(tasks)))
    stars = cut(joined.groupBy("_task").applyInArrow(_linked(threshold, buckets), "_a long, _b long, _others long"), "vector-links")
    forget(hashed, shared)

    degree = stars.groupBy(F.col("_a").alias("_node")).agg(F.sum("_others").alias("_others"))
    whole = components(stars.select("_a", "_b"), "_a", "_b").withColumnRenamed("node", "_node")
    names = classes.drop("_x")
    least = whole.join(names, "_node").groupBy("component").agg(F.min("_rep").alias("_first"))
    linked = whole.join(least, "component").select("_node", "_first")
    per_class = cut(names.join(degree, "_node", "left").join(linked, "_node", "left").drop("_node"), "class-links")
    out = marked.select("_id", "_digest").join(per_class, "_digest", "left")
    component = F.coalesce("_first", "_rep", "_id")
    return out.select(F.col("_id").alias(id_col), (F.coalesce("_size", F.lit(1)) - 1 + F.coalesce("_others", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
