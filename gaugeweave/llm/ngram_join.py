"""Near duplicates by n-gram Jaccard, with signature trees.

1. Every text becomes its set of hashed 5-word shingles.  Equal sets are one node from here on.
2. Each node is listed under the first shingles of its set, in one order of all shingles.  Two sets that reach the
   threshold share one of these (prefix filtering, Chaudhuri et al. 2006), so a bucket (the nodes under one shingle) is
   where trees have to look; no link is lost here.  The order, rare shingles first, is only an aid: a passage that many
   texts share comes last and brings few of them together.
3. Signature trees find all links.  A leaf holds a set's bitmap and size, an inner node the OR of the bitmaps below and
   their range of sizes.  Two subtrees are walked at once; a pair of nodes is left when the largest overlap that its
   bitmaps and sizes allow can't reach the threshold, or when all below both is in one group already.  Pairs of leaves
   that are reached are compared in full at once, and a link joins their groups.
4. In ``passes`` turns every node goes to one of its buckets, the one with the smallest draw of the turn, where a tree
   joins most near copies at little cost: of a bucket's group one node goes on to the next turn.
5. What is left are buckets with nodes of several groups.  Each is joined in full: its nodes are cut into blocks by range
   of sizes, and pairs of blocks whose sizes or groups rule a link out are left before rows are moved.
6. Links and copies give the components.

Similarity is compared in whole numbers: 100 * intersection >= percent * union.

Defined results: null and empty texts, or texts without words, have no shingle and link with nothing; texts with fewer
words than ``width`` are one shingle of all their words; equal texts link; rows that repeat an id with different texts
are documents of their own under one id; a null id gets a null component and links with nothing; an empty table gives an
empty table; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, forget, small, text_batches
from .textbytes import U, blocks, mix, stream, tidy, words

BITS = 4096
FANOUT = 8

#: Shingles are counted in so many slots for the order of rarity.
SLOTS = 1 << 18


def shingles(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the shingles of a block of texts, in order and with repeats, and where each text's begin."""
    factor = stream(21, width)
    for _, data, offsets in blocks(column):
        _, _, text, h = words(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(text, minlength=n)
        first = np.append(0, np.cumsum(count))
        s = np.zeros(max(0, len(h) - width + 1), U)
        for k in range(width):
            s += h[k : k + len(s)] * factor[k]
        own = text[: len(s)] == text[width - 1 :] if len(s) else np.zeros(0, bool)
        whole, of = [mix(s[own])], [text[: len(s)][own]]
        brief = np.flatnonzero((count > 0) & (count < width))
        if len(brief):
            whole.append(mix(np.array([(h[first[i] : first[i + 1]] * factor[: count[i]]).sum() + U(count[i]) for i in brief.tolist()], U)))
            of.append(brief)
        s, of = np.concatenate(whole), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        yield s[order], np.append(0, np.cumsum(np.bincount(of, minlength=n)))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for s, first in shingles(column, width):
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = np.sort(s[lo:hi])
            yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def identity(own: np.ndarray) -> np.ndarray:
    """A 64-bit number of a set of shingles."""
    return mix(np.array([own.sum(dtype=U)]) + mix(np.array([mix(own).sum(dtype=U) ^ U(len(own))])))


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """Of each slot of shingles how common it is, from 0 to 63: four steps for every doubling beyond 1.2 times the mean.

    ``texts`` has one column.  All shingles of all texts are counted; SLOTS numbers, whatever the input, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s, _ in shingles(batch.column(0), width):
                total += np.bincount((s >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64), minlength=SLOTS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["slot", "n"])

    rows = texts.mapInArrow(tidy(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SLOTS)
    n[rows["slot"].to_numpy(int)] = rows["n"].to_numpy(float)
    return np.clip(np.ceil(4 * np.log2(np.maximum(n, 1) / max(n.mean(), 1) / 1.2)), 0, 63).astype(np.uint8)


def spare(n: int, percent: int) -> int:
    """How many elements of a set of ``n`` another one at the threshold may lack."""
    return n - (percent * n + 99) // 100


def prefix(own: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones first, and how many of them are its core.

    A prefix has ``extra`` = 1 + spare // 4 more shingles than another set at the threshold may lack, so both share that
    many of them (the smaller number of the two).  They are in the smaller set's core, which counts what the smaller of two
    sets may lack.
    """
    n = len(own)
    lack, extra = spare(n, percent), 1 + spare(n, percent) // 4
    level = common[(own >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)].astype(U)
    first = np.sort(np.partition(level << U(58) | own >> U(6), min(n, lack + extra) - 1)[: lack + extra])
    return first, n - -(-2 * percent * n // (100 + percent)) + extra


def _signer(width: int, percent: int, common: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys, cores = [], [], [], []
            for own in shingle_sets(batch.column(1), width):
                first, core = prefix(own, percent, common) if len(own) else (own, 0)
                sizes.append(len(own)), nodes.append(identity(own)[0]), keys.append(first.view(np.int64)), cores.append(core)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, U).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(cores, pa.int32())], names=["_id", "_node", "_n", "_keys", "_core"])

    return sign


def bitmap(own: np.ndarray) -> bytes:
    marks = np.zeros(BITS, bool)
    marks[(own >> U(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _sets(width: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat an id and its text
        for batch in batches:
            nodes, values, maps, sizes = [], [], [], []
            for own in shingle_sets(batch.column(0), width):
                if len(own) and (node := int(identity(own)[0])) not in seen:
                    seen.add(node), nodes.append(node), values.append(own.tobytes()), maps.append(bitmap(own)), sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, U).view(np.int64)), pa.array(values, pa.binary()), pa.array(maps, pa.binary()), pa.array(sizes, pa.int64())], names=["_node", "_set", "_map", "_n"])

    return full


class Node:
    """A node of a signature tree: OR of the bitmaps, range of sizes, group (None where several), children or the set.

    ``excess`` is the most by which a set below is larger than its bitmap: so many elements of an overlap can hide behind
    shared bits.
    """

    __slots__ = ("bits", "low", "high", "excess", "group", "below", "own", "name")

    def __init__(self, below: list[Node]):
        self.below, self.own, self.name = below, None, 0
        self.bits = 0
        for x in below:
            self.bits |= x.bits
        self.low, self.high = min(x.low for x in below), max(x.high for x in below)
        self.excess = max(x.excess for x in below)
        self.group = None

    @classmethod
    def leaf(cls, name: int, group: int, size: int, bits: bytes, own: np.ndarray | None) -> Node:
        out = cls.__new__(cls)
        out.bits = int.from_bytes(bytes(bits), "big")
        out.low = out.high = size
        out.excess = size - out.bits.bit_count()
        out.group, out.below, out.own, out.name = group, [], own, name
        return out


class Groups:
    """Groups that links join."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


def reachable(a: Node, b: Node, percent: int) -> bool:
    """Whether sets below two nodes can reach the threshold: their overlap is at most the shared bits and an excess."""
    most = min(a.high, b.high, (a.bits & b.bits).bit_count() + min(a.excess, b.excess))
    return most > 0 and 100 * most >= percent * (max(a.low, most) + max(b.low, most) - most)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def walk(a: Node, b: Node, groups: Groups, percent: int, links: list[tuple[int, int]]) -> None:
    """Walk two subtrees at once; append a link for every two groups that are joined."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a.group is not None and b.group is not None and groups.top(a.group) == groups.top(b.group):
            continue
        if not reachable(a, b, percent):
            continue
        if not a.below and not b.below:
            if a.own is None:
                links.append((a.name, b.name))
            elif alike(a.own, b.own, percent):
                groups.join(a.group, b.group)
                links.append((a.name, b.name))
        elif a.below and (a.high - a.low >= b.high - b.low or not b.below):
            stack += [(x, b) for x in a.below]
        else:
            stack += [(a, x) for x in b.below]


def tree_of(leaves: list[Node], groups: Groups, percent: int, links: list[tuple[int, int]] | None) -> Node:
    """The tree over ``leaves``; with ``links``, every level's children are walked against each other as it grows.

    From below, so that what few comparisons have joined is one group when larger subtrees meet.
    """
    count: dict[int, int] = {}
    for x in leaves:
        count[x.group] = count.get(x.group, 0) + 1
    level = sorted(leaves, key=lambda x: (x.group if count[x.group] > 1 else 0, x.low, x.name))
    while True:
        above = []
        for k in range(0, len(level), FANOUT):
            own = level[k : k + FANOUT]
            if links is not None:
                for i, x in enumerate(own):
                    for y in own[:i]:
                        walk(x, y, groups, percent, links)
            node = Node(own)
            if all(x.group is not None for x in own) and len({groups.top(x.group) for x in own}) == 1:
                node.group = own[0].group
            above.append(node)
        level = above
        if len(level) == 1:
            return level[0]


def meeting_members(keyed: DataFrame, percent: int, block: int) -> DataFrame:
    """Of ``keyed`` (_key, _node, _n, _in_core) the rows (_key, _node, _n) that may link inside their bucket.

    A pair meets in a bucket only if the smaller of its sets has the shingle in its core, and only if their sizes are
    near.  Sizes are compared with the next ones in the bucket, in a bucket beyond ``block`` rows of a part of it only.
    Rows are moved once, to their bucket.
    """
    bucket, size = Window.partitionBy("_key"), F.col("_n")
    core = F.when(F.col("_in_core"), size)
    rows = keyed.withColumns({"_m": F.count("*").over(bucket), "_a": F.min(core).over(bucket), "_b": F.max(core).over(bucket)})
    rows = rows.where((F.col("_m") > 1) & F.col("_a").isNotNull() & (F.col("_in_core") | ((size >= F.col("_a")) & (percent * size <= 100 * F.col("_b")))))
    crowd = F.when(F.col("_m") > block, F.xxhash64("_node")).otherwise(F.lit(0))
    by_size = Window.partitionBy("_key", crowd).orderBy("_n", "_node")
    near = (percent * size <= 100 * F.lag("_n").over(by_size)) | (percent * F.lead("_n").over(by_size) <= 100 * size)
    rows = rows.withColumn("_near", (F.col("_m") > block) | F.coalesce(near, F.lit(False))).where("_near")
    return rows.select("_key", "_node", F.col("_n").cast("long").alias("_n"))


def often_met(members: DataFrame, percent: int) -> DataFrame:
    """Rows of the nodes that share at least as many shingles as their prefix has with one at the threshold (see ``prefix``)."""
    least = F.ceil(F.lit(percent) * F.col("_n") / 100)  # the smallest size that may link
    enough = 1 + F.floor((least - F.ceil(percent * least / 100)) / 4)
    nodes = members.groupBy("_node", "_n").agg(F.count("*").alias("_k")).where(F.col("_k") >= enough).select("_node")
    return members.join(nodes, "_node", "left_semi")


def _join(percent: int, full: bool):
    """Links of every ``_meeting`` of a task: of its rows, or where it has two sides, between them."""

    def join(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("_meeting", "_side", "_node", "_c", "_n", "_map")]
        sets = table["_set"].combine_chunks() if full else None
        meetings: dict[int, tuple[list, list]] = {}
        for i, (meeting, side, *leaf) in enumerate(zip(*columns, strict=True)):
            meetings.setdefault(meeting, ([], []))[side].append((*leaf, np.frombuffer(sets[i].as_buffer(), U) if full else None))
        links: list[tuple[int, int]] = []
        for sides in meetings.values():
            groups = Groups()
            leaves = [[Node.leaf(*x) for x in side] for side in sides]
            if leaves[0] and leaves[1]:
                walk(*[tree_of(x, groups, percent, None) for x in leaves], groups, percent, links)
            else:
                tree_of(leaves[0] or leaves[1], groups, percent, links)
        return pa.table({"_x": pa.array([x for x, _ in links], pa.int64()), "_y": pa.array([y for _, y in links], pa.int64())})

    return join


def tree_links(rows: DataFrame, sets: DataFrame, percent: int, per_task: int, most_rows: int, full: bool = True) -> DataFrame:
    """Links (_x, _y) from ``rows`` (_meeting, _side, _node, _c): enough to join all groups that links join.

    Meetings are dealt to tasks of about ``per_task`` rows.  Rows go with their sets; unless ``full``, with their bitmaps
    only, and all pairs of leaves that trees reach are returned.
    """
    tasks = max(1, -(-rows.count() // per_task))
    dealt = small(rows.withColumn("_task", F.pmod(F.xxhash64("_meeting"), F.lit(tasks))), most_rows)
    return (sets if full else sets.drop("_set")).join(dealt, "_node").groupBy("_task").applyInArrow(_join(percent, full), "_x long, _y long")


def _compared(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_x", "_y"]).filter(pa.array(good, pa.bool_()))

    return compare


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (_x, _y) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("_node").alias(c), F.col("_set").alias(f"_s{c}"))
    both = pairs.join(side("_x"), "_x").join(side("_y"), "_y").select("_x", "_y", "_s_x", "_s_y")
    return both.mapInArrow(tidy(_compared(percent)), "_x long, _y long")


def block_meetings(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """(_meeting, _side, _node, _c) of buckets ``rows`` (_key, _node, _n, _c) with nodes of several groups.

    Buckets that hold the same nodes meet once.  A bucket beyond ``block`` rows is cut into blocks by range of sizes (a
    factor of 1.25 each) and, within one, by group; pairs of blocks that sizes or groups of their roots rule out are not
    formed.
    """
    mixed = rows.groupBy("_key").agg(F.count("*").alias("_m"), F.sum(F.xxhash64("_node").cast("decimal(38,0)")).alias("_h"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    mixed = mixed.where((F.col("_lo") != F.col("_hi")) & ((F.col("_m") > 2) | (100 * F.col("_a") >= percent * F.col("_b"))))
    once = mixed.groupBy("_m", "_h").agg(F.min("_key").alias("_key"))
    rows = rows.join(once.select("_key", "_m"), "_key")
    span = F.floor(F.log(F.col("_n")) / F.log(F.lit(1.25)))
    part = F.when(F.col("_m") <= block, F.lit(0)).otherwise(F.xxhash64(span, F.pmod(F.xxhash64("_c"), F.ceil(F.col("_m") / block))))
    rows = rows.withColumn("_part", part)
    large = rows.groupBy("_key", "_part").agg(F.count("*").alias("_of"))
    rows = rows.join(large, ["_key", "_part"]).withColumn("_part", F.when(F.col("_of") > 2 * block, F.xxhash64("_part", F.pmod(F.xxhash64("_node"), F.ceil(F.col("_of") / block)))).otherwise(F.col("_part")))
    rows = cut(rows.select("_key", "_part", "_node", "_n", "_c"), "blocks")
    roots = rows.groupBy("_key", "_part").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.min("_c").alias("_g"), F.max("_c").alias("_h"))
    other = roots.select("_key", *[F.col(c).alias(f"{c}2") for c in ("_part", "_lo", "_hi", "_g", "_h")])
    near = (100 * F.col("_hi") >= percent * F.col("_lo2")) & (100 * F.col("_hi2") >= percent * F.col("_lo"))
    one = (F.col("_g") == F.col("_h")) & (F.col("_g2") == F.col("_h2")) & (F.col("_g") == F.col("_g2"))
    pairs = roots.join(other, "_key").where((F.col("_part") <= F.col("_part2")) & near & ~one).select("_key", "_part", "_part2")
    meeting = F.xxhash64("_key", "_part", "_part2").alias("_meeting")
    left = rows.join(pairs, ["_key", "_part"]).select(meeting, F.lit(0).alias("_side"), "_node", "_c")
    right = rows.withColumnRenamed("_part", "_part2").join(pairs, ["_key", "_part2"]).where("_part <> _part2").select(meeting, F.lit(1).alias("_side"), "_node", "_c")
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = 1024, passes: int = 2, per_task: int = 8192, most_rows: int = 1_000_000) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id that links reach).  Ids are whole numbers.

    Tables of up to ``most_rows`` rows of a few numbers are broadcast; beyond it Spark shuffles.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    with text_batches(docs.sparkSession):
        common = rarity(plain.select("_text"), width)
    signed = cut(plain.mapInArrow(tidy(_signer(width, percent, common)), "_id long, _node long, _n long, _keys array<long>, _core int"), "signed", texts=True)
    usable = "_n > 0 and _id is not null"
    copied = cut(signed.where(usable).groupBy("_node").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")).where("_copies > 1").select("_node", "_rep"), "copies")

    def one_each(rows: DataFrame) -> DataFrame:
        rows = rows.where(usable).join(small(copied, most_rows), "_node", "left")
        return rows.where("_rep is null").unionByName(rows.where("_id = _rep").dropDuplicates(["_node"]))  # rows may repeat

    keyed = one_each(signed).select("_node", F.col("_n").cast("int").alias("_n"), "_core", F.posexplode("_keys").alias("_at", "_key"))
    keyed = keyed.select("_key", "_node", "_n", (F.col("_at") < F.col("_core")).alias("_in_core"))
    buckets = cut(meeting_members(keyed, percent, block), "buckets")
    placed = cut(signed.select("_id", "_node", "_n"), "nodes")
    forget(signed)  # its lists of shingles
    members = cut(often_met(buckets, percent), "members")
    met = cut(members.select("_node").distinct(), "met")
    met_ids = cut(one_each(placed).join(small(met, most_rows), "_node", "left_semi").select("_id"), "met-ids")
    picked = plain.join(small(met_ids, most_rows), "_id", "left_semi").select("_text")
    sets = cut(picked.mapInArrow(tidy(_sets(width)), "_node long, _set binary, _map binary, _n long"), "sets", texts=True)
    forget(buckets, met, met_ids)

    links = None
    for turn in range(passes + 1):
        grouped = members.withColumn("_c", F.col("_node"))
        if links is not None:
            groups = components(links, "_x", "_y")
            grouped = members.join(groups.withColumnRenamed("node", "_node"), "_node", "left").select("_key", "_node", "_n", F.coalesce("component", "_node").alias("_c"))
        if turn == passes:
            break
        going = grouped
        if links is not None:  # of buckets with several groups, one node of each
            draw = F.xxhash64(F.lit(turn), "_key", "_node")
            going = grouped.groupBy("_key", "_c").agg(F.min_by("_node", draw).alias("_node"))
            several = going.groupBy("_key").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi").select("_key")
            going = going.join(several, "_key")
        home = going.groupBy("_node", "_c").agg(F.min_by("_key", F.xxhash64(F.lit(turn), "_key")).alias("_key"))
        home = cut(home, "homes")
        full = home.groupBy("_key").agg(F.count("*").alias("_m")).where("_m > 1")
        part = F.pmod(F.xxhash64("_node"), F.ceil(F.col("_m") / block))
        rows = cut(home.join(full, "_key").select(F.xxhash64("_key", part).alias("_meeting"), F.lit(0).alias("_side"), "_node", "_c"), "meetings")
        fresh = tree_links(rows, sets, percent, per_task, most_rows)
        if links is not None:
            fresh = fresh.unionByName(groups.select(F.col("node").alias("_x"), F.col("component").alias("_y")))
        links = cut(fresh, "tree-links")
        forget(home, rows)
    grouped = cut(grouped, "grouped")
    forget(members)
    rows = cut(block_meetings(grouped, percent, block), "meetings")
    forget(grouped)
    met = F.struct(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    reached = cut(tree_links(rows, sets, percent, per_task, most_rows, full=False).select(met.alias("_p")).select("_p.*").distinct(), "reached")
    links = links.unionByName(cut(verified(reached, sets, percent), "verified"))
    forget(rows, reached, sets)
    whole = components(links, "_x", "_y")

    # Rows with copies or links; all others stand for themselves.
    rep = placed.where(usable).join(whole.select(F.col("node").alias("_node"), "component"), "_node").groupBy("component").agg(F.min("_id").alias("_first"))
    linked = whole.select(F.col("node").alias("_node"), "component").join(rep, "component").select("_node", "_first")
    known = cut(copied.join(linked, "_node", "full_outer").select("_node", F.coalesce("_first", "_rep").alias("_first")), "placed")
    placed = placed.join(small(known, most_rows), "_node", "left")
    component = F.when(F.col("_id").isNotNull(), F.when(F.col("_n") > 0, F.coalesce("_first", "_id")).otherwise(F.col("_id")))
    return placed.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows that repeat an id stay if one of them does."""
    places = near_duplicates(docs, id_col, text_col, most_rows=most_rows, **options)
    stays = F.max(F.col(id_col) == F.col("component_id"))
    losers = cut(places.groupBy(F.col(id_col).alias("_gw_id")).agg(stays.alias("_gw_stays")).where("not _gw_stays").select("_gw_id"), "near-copies")
    return docs.join(small(losers, most_rows), F.col(id_col) == F.col("_gw_id"), "left_anti")
