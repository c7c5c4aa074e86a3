"""Trees as tables: numbering, pruning and merging, the fold's defined cases on both of its ways, and sweeps of fits."""

import math
import random

import numpy as np
import pytest

from gaugeweave.operators import hierarchy, regress, treefold, treemodels

EDGES = "tree_id string, parent string, child string, length double"
TIPS = "tree_id string, fit string, node string, x double, y double"


def random_trees(rng, n=60, names="ab"):
    rows = []
    for t in names:
        for i in range(1, n):
            rows.append((t, f"{t}{rng.randrange(i) if rng.random() < 0.6 else i - 1}", f"{t}{i}", rng.choice([0.0, 0.5, 1.5])))
    return rows


def below(rows):
    """{(tree, node): all nodes at or below}, {(tree, node): parent}, inner nodes."""
    up = {(t, c): p for t, p, c, _ in rows}
    nodes = {(t, x) for t, p, c, _ in rows for x in (p, c)}
    out = {v: set() for v in nodes}
    for t, x in nodes:
        at = x
        while at is not None:
            out[t, at].add(x)
            at = up.get((t, at))
    return out, up, {(t, p) for t, p, _, _ in rows}


@pytest.mark.parametrize("most", [0, 10_000])
def test_numbers_of_nodes(spark, most):
    rows = random_trees(random.Random(4)) + [("c", "c0", f"s{i:02}", 1.0) for i in range(40)] + [("c", "d0", "d1", 1.0)]  # two roots, a wide node
    rng = random.Random(5)
    under, up, inner = below(rows)
    marks = sorted(v for v in under if rng.random() < 0.3)
    got = hierarchy.intervals(spark.createDataFrame(rows + rows[:7], EDGES), spark.createDataFrame(marks, "tree_id string, node string"), most).collect()
    of = {(r["tree_id"], r["node"]): r for r in got}
    assert len(got) == len(of) and set(of) == set(under)
    for (t, x), r in of.items():
        inside = under[t, x]
        assert {y for (s, y), q in of.items() if s == t and r["enter"] <= q["enter"] <= r["leave"]} == inside
        tips = {y for y in inside if (t, y) not in inner}
        assert r["tips"] == len(tips) and r["marked"] == sum((t, y) in marks for y in inside) and r["parent"] == up.get((t, x))
        assert {y for (s, y), q in of.items() if s == t and (s, y) not in inner and r["first_tip"] <= q["first_tip"] < r["first_tip"] + r["tips"]} == tips
        assert r["level"] == sum(x in v for (s, _), v in under.items() if s == t) - 1
    for t in "abc":  # numbers are those of the walk by name
        assert sorted(r["enter"] for (s, _), r in of.items() if s == t) == list(range(1, 1 + sum(s == t for s, _ in of)))


def test_both_ways_number_alike(spark):
    e = spark.createDataFrame(random_trees(random.Random(6)), EDGES)
    assert sorted(map(tuple, hierarchy.intervals(e, most=0).collect()), key=str) == sorted(map(tuple, hierarchy.intervals(e).collect()), key=str)
    for rows in ([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], [("t", "r", "x", 1.0), ("t", "b", "c", 1.0), ("t", "c", "b", 1.0)]):
        for most in (0, 100):
            with pytest.raises(Exception, match="cycle"):
                hierarchy.intervals(spark.createDataFrame(rows, EDGES), most=most).collect()
        with pytest.raises(ValueError):
            hierarchy.climbed(spark.createDataFrame(rows, EDGES))


def test_ladder_of_100000_edges(spark):
    n = 50_000
    e = spark.range(n).selectExpr("'t' as tree_id", "concat('k', id) as parent", "inline(array(struct(concat('k', id + 1) as child, 1.0D as length), struct(concat('x', id) as child, 2.0D as length)))")
    counts = {r["node"]: r["tips"] for r in hierarchy.tip_counts(e).where("node in ('k0', 'k49990', 'x3')").collect()}
    assert counts == {"k0": n + 1, "k49990": 11, "x3": 1}
    assert hierarchy.clades(e, 20).groupBy("clade").count().where("count = 20").count() == 1
    far = {r["node"]: r["distance"] for r in hierarchy.climbed(e).where("node in ('k1', 'k50000', 'x49999')").collect()}
    assert far == {"k1": 1.0, "k50000": 50_000.0, "x49999": 50_001.0}


def test_pruned_and_contracted(spark):
    rows = random_trees(random.Random(9), 80)
    under, up, inner = below(rows)
    rng = random.Random(1)
    keep = {v for v in under if v not in inner and rng.random() < 0.3}
    e, k = spark.createDataFrame(rows, EDGES), spark.createDataFrame(sorted(keep), "tree_id string, node string")
    less = hierarchy.pruned(e, k)
    assert {(r["tree_id"], r["child"]) for r in less.collect()} == {v for v in up if {(v[0], y) for y in under[v]} & keep}
    merged = hierarchy.contracted(less).collect()
    kids = {}
    for r in merged:
        kids.setdefault((r["tree_id"], r["parent"]), []).append(r["child"])
    assert all(len(c) > 1 for c in kids.values()) and {(r["tree_id"], r["child"]) for r in merged} - set(kids) == keep
    tips = [(t, "f", x, rng.random(), rng.random()) for t, x in sorted(keep)]
    d = spark.createDataFrame(tips, TIPS)
    folds = [sorted(map(tuple, treefold.fold(s, d).collect())) for s in (e, less, spark.createDataFrame(merged, EDGES))]
    for rows in folds[1:]:
        for a, b in zip(folds[0], rows, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    chain = spark.createDataFrame([("t", "r", "a", 1.0), ("t", "a", "b", 2.0), ("t", "b", "c", 4.0), ("t", "b", "d", 1.0), ("t", "d", "e", 1.0), ("u", "r", "a", 1.0)], EDGES)
    assert sorted(map(tuple, hierarchy.contracted(chain).collect())) == [("t", "b", "c", 4.0), ("t", "b", "e", 2.0)]


TREE = [("t", "r", "a", 1.0), ("t", "a", "b", 1.0), ("t", "a", "c", 2.0), ("t", "r", "d", 1.5), ("t", "r", "e", None)]
DATA = [("t", "f", "b", 1.0, 2.0), ("t", "f", "c", 2.0, 1.0), ("t", "f", "d", 4.0, 3.0)]


CASES = [  # more edges and data, and those that give the same fits
    ([], [("t", "f", "a", 3.0, 5.0)], [("t", "a", "hung", 0.0)], [("t", "f", "hung", 3.0, 5.0)]),  # data on an inner node
    ([], [("t", "f", "r", 3.0, 5.0)], [("t", "r", "hung", 0.0)], [("t", "f", "hung", 3.0, 5.0)]),  # ... on the root
    (TREE[:3], [], [], []),  # repeated edges
    ([], [("t", "f", "e", float("nan"), 1.0), ("t", "f", "gone", 1.0, 1.0), ("t", "f", "e", 1.0, float("inf"))], [], []),  # missing values, unknown nodes
    ([("t", None, "b", 1.0), (None, "r", "q", 1.0)], [("t", "f", None, 1.0, 1.0)], [], []),
    ([], [("t", "f", "e", 0.5, 0.5)], [("t", "r", "e2", 0.0)], [("t", "f", "e2", 0.5, 0.5)]),  # a null length
    ([], [("t", None, *r[2:]) for r in DATA], [], [("t", None, *r[2:]) for r in DATA]),  # a fit without a name
]


@pytest.mark.parametrize("most", [0, 10_000])
def test_fold_of_odd_rows_is_one_at_every_size(spark, most):
    edges, tips = [], []
    for i, (more_edges, more_data, same_edges, same_data) in enumerate(CASES):
        for name, e, d in ((f"t{i}", more_edges, more_data), (f"s{i}", same_edges, same_data)):
            edges += [(r[0] and name, *r[1:]) for r in TREE + e]
            tips += [(name, *r[1:]) for r in DATA + d]
    got = {(r["tree_id"], r["fit"]): tuple(r)[2:] for r in treefold.fold(spark.createDataFrame(edges, EDGES), spark.createDataFrame(tips, TIPS), most=most).collect()}
    assert len(got) == 2 * len(CASES) + 2
    for (tree, fit), row in got.items():
        assert row == pytest.approx(got["s" + tree[1:], fit])


@pytest.mark.parametrize("most", [0, 10_000])
@pytest.mark.parametrize(
    "edges, data, says",
    [
        ([*TREE, ("t", "d", "b", 1.0)], DATA, "two parents"),
        ([*TREE, ("t", "a", "b", 3.0)], DATA, "two parents or lengths"),
        (TREE, [*DATA, ("t", "f", "b", 1.0, 2.0)], "several rows"),
        ([*TREE, ("t", "y", "z", 1.0), ("t", "z", "y", 1.0)], DATA, "cycle"),
        ([*TREE, ("t", "y", "z", 1.0)], [*DATA, ("t", "f", "z", 1.0, 2.0)], "common ancestor"),
    ],
)
def test_fold_of_wrong_trees_raises_at_every_size(spark, most, edges, data, says):
    with pytest.raises(Exception, match=says):
        treefold.fold(spark.createDataFrame(edges, EDGES), spark.createDataFrame(data, TIPS), most=most).collect()


def test_fold_counts_from_the_last_common_ancestor(spark):
    for most in (0, 10_000):
        e, d = spark.createDataFrame(TREE, EDGES), spark.createDataFrame(DATA[:2] + [("t", "g", "d", 1.0, 1.0)], TIPS)
        got = {r["fit"]: r for r in treefold.fold(e, d, most=most).collect()}
        assert got["f"]["logdet"] == pytest.approx(math.log(1.0 * 2.0)) and got["f"]["n"] == 2  # lengths of b and c alone
        assert got["g"]["n"] == 1 and got["g"]["slope"] is None and got["g"]["sxx"] == 0
    assert treefold.fold(e, d.limit(0)).count() == 0 and treefold.fold(e.limit(0), d).count() == 0


def test_fits_of_a_tree_spread_over_tasks(spark):
    rng = random.Random(2)
    rows = random_trees(rng, 40)
    tips = [(t, f"f{k}", f"{t}{i}", rng.random(), rng.random()) for t in "ab" for k in range(30) for i in range(1, 40) if rng.random() < 0.7]
    e, d = spark.createDataFrame(rows, EDGES), spark.createDataFrame(tips, TIPS)
    one, many = (sorted(map(tuple, treefold.fold(e, d, per_task=n).collect())) for n in (10**6, 10))
    assert len(one) == 60 and [r[:2] for r in one] == [r[:2] for r in many]
    assert all(a[2:] == pytest.approx(b[2:]) for a, b in zip(one, many, strict=True))


def covariance(rows, tree, tips):
    _, up, _ = below(rows)
    length = {(t, c): v for t, _, c, v in rows}

    def path(x):
        return [] if (tree, x) not in up else [x, *path(up[tree, x])]

    return np.array([[sum(max(length[tree, n], treefold.FLOOR) for n in set(path(a)) & set(path(b))) for b in tips] for a in tips])


def dense(v, x, y):
    x = np.array([[1.0, a] for a in x])
    inverse = np.linalg.inv(v)
    return np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ np.array(y))


def test_sweep_equals_dense_least_squares(spark):
    rng = random.Random(12)
    rows = [(t, p, c, rng.uniform(0.5, 2)) for t in "abc" for p, c in [("r", "u"), ("r", "w"), ("u", "v")] + [(rng.choice("ruvw"), f"x{i}") for i in range(24)] if (t, c) != ("b", "x3")]
    value = lambda: rng.choice([None, float("nan"), *[rng.gauss(0, 1) for _ in range(8)]])
    traits = [(f"x{i}", rng.choice(["g", "h", None]), value(), value(), rng.gauss(0, 1)) for i in range(24)] + [("elsewhere", "g", 1.0, 1.0, 1.0)]
    got = regress.sweep(spark.createDataFrame(rows, EDGES), spark.createDataFrame(traits, "node string, kind string, p double, q double, z double"), [("pq", "p", "q", None), ("qz", "q", "z", None), ("pq|z", "p", "q", "z")], "kind", least=4).collect()
    have = {(r["tree_id"], r["comparison"], r["group"]): r for r in got}
    fine = lambda v: v is not None and v == v
    checked = 0
    for t in "abc":
        there = {c for s, _, c, _ in rows if s == t}
        for group in ("ALL", "g", "h"):
            for name, use in (("pq", (2, 3, None)), ("qz", (3, 4, None)), ("pq|z", (2, 3, 4))):
                own = [r for r in traits if r[0] in there and group in ("ALL", r[1]) and all(fine(r[k]) for k in use if k)]
                if len(own) < 4:
                    assert (t, name, group) not in have
                    continue
                v = covariance(rows, t, [r[0] for r in own])
                x, y = ([r[k] for r in own] for k in use[:2])
                if use[2]:
                    z = [r[use[2]] for r in own]
                    x, y = ((lambda b, s: [u - b[0] - b[1] * w for u, w in zip(s, z, strict=True)])(dense(v, z, s), s) for s in (x, y))
                intercept, slope = dense(v, x, y)
                r = have[t, name, group]
                assert r["slope"] == pytest.approx(slope) and r["intercept"] == pytest.approx(intercept) and r["n"] == len(own)
                checked += 1
    assert checked == len(have) > 20


def test_depths_of_deep_trees(spark):
    e = spark.createDataFrame([("t", f"k{i}", f"k{i + 1}", 0.5) for i in range(300)], EDGES)
    rows = {r["child"]: r for r in treemodels.depths(e).collect()}
    assert rows["k300"]["bottom"] == 150.0 and rows["k300"]["top"] == 149.5 and rows["k1"]["deepest"] == 150.0


def broad_trees():
    """Families of very different sizes, chains between them, two roots; names order leaves among inner siblings."""
    rng, rows = random.Random(21), []
    for t in "ab":
        for i in range(6):
            rows.append((t, f"{t}root{i % 2}", f"{t}{i:02}", 1.0))
            for j in range(rng.randrange(4)):
                rows += [(t, f"{t}{i:02}", f"{t}{i:02}k{j}", 2.0), (t, f"{t}{i:02}k{j}", f"{t}{i:02}k{j}m", 0.5)]
                rows += [(t, f"{t}{i:02}k{j}m", f"{t}{rng.randrange(10**6)}x{i}{j}{k}", 1.0) for k in range(rng.choice([1, 5, 60]))]
    return rows


@pytest.mark.parametrize("most", [0, 1, 5, 20, 100])
def test_peeled_trees_number_alike(spark, monkeypatch, most):
    monkeypatch.setattr(hierarchy, "_ranked", lambda nodes: pytest.fail("list ranking of a flat tree"))
    rows = broad_trees()
    rng = random.Random(3)
    marks = spark.createDataFrame([(t, c) for t, _, c, _ in rows if rng.random() < 0.3], "tree_id string, node string")
    e = spark.createDataFrame(rows, EDGES)
    whole = sorted(map(tuple, hierarchy.intervals(e, marks).collect()), key=str)
    assert sorted(map(tuple, hierarchy.intervals(e, marks, most).collect()), key=str) == whole


def test_one_parent_with_most_nodes_over_many_partitions(spark):
    e = spark.range(30_000).selectExpr("'t' as tree_id", "'r' as parent", "concat('x', id) as child", "1.0D as length")
    assert sorted(map(tuple, hierarchy.intervals(e, most=10).select("node", "enter", "first_tip").collect())) == sorted(map(tuple, hierarchy.intervals(e).select("node", "enter", "first_tip").collect()))


@pytest.mark.parametrize("most", [0, 10_000])
def test_variants_of_lengths_are_folds_of_their_own(spark, most):
    rows = broad_trees()
    rng = random.Random(8)
    tips = [(t, f, c, rng.random(), rng.random()) for t, _, c, _ in rows for f in "fg" if c[1] == "0" and rng.random() < 0.5]
    roots = [(t, "top", f"{t}root{i}", 1.0) for t in "ab" for i in range(2)]
    e, d = spark.createDataFrame(rows + roots, EDGES), spark.createDataFrame(tips, TIPS)
    both = treefold.fold_each(hierarchy.sound(e), d, [hierarchy.F.col("length"), hierarchy.F.col("length") * 2 - 1], most=most).collect()
    for variant, length in enumerate(("length", "length * 2 - 1")):
        one = sorted(map(tuple, treefold.fold(e.selectExpr("tree_id", "parent", "child", f"{length} as length"), d).collect()))
        got = sorted((*r[:2], *r[3:]) for r in map(tuple, both) if r[2] == variant)
        assert len(one) == 4 and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6) for a, b in zip(one, got, strict=True))


def test_models_fold_every_edge_once(spark, monkeypatch):
    seen, whole = [], treefold.fold_each
    monkeypatch.setattr(treemodels, "fold_each", lambda edges, *more: seen.append(edges.count()) or whole(edges, *more))
    e = spark.createDataFrame(broad_trees(), EDGES)
    tips = hierarchy.tips_of(e).selectExpr("tree_id", "'trait' as trait", "node", "length(node) * 1.5 as y").where("node like '_0%'")
    treemodels.model_fits(e, tips.limit(0), {"lambda": [0.5], "early": [0.1]}).collect()
    assert seen == [e.count()]
