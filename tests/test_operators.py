"""Hand-made rows for null rules, odd records, sources and trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import classify, clean, hierarchy, hulls, keys, measures, regress, reports, stats, textmine, treefold, treemodels
from gaugeweave.sources import files
from gaugeweave.streaming import ingest


def test_estimate_cascade_and_axes(spark):
    rows = [(1.0, None, None, None), (None, 2.0, 4.0, 9.0), (None, 2.0, None, 9.0), (None, None, None, 9.0), (1.0, 2.0, 4.0, 9.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, m double, x double, p double")
    assert [r[0] for r in df.select(measures.estimate("a", "m", "x", "p")).collect()] == [1.0, 3.0, None, 9.0, 1.0, None]
    pairs = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 2.0)], "w double, b double").select(*measures.axes("w", "b")).collect()
    assert [tuple(r) for r in pairs] == [(1.0, None), (2.0, 2.0), (2.0, 1.0)]


def test_trim_keeps_nulls_and_drops_the_limit(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r[0] or 0 for r in measures.trim_above(df, "v", 1.0).collect()) == [0, 1.0, 2.0]


def test_number_near(spark):
    rows = [("a 1,5 mm 22 b", 7, "1,5"), ("12 x 34", 4, "12"), ("12345678 kw 9", 10, "12345678"), ("x kw (2.5 - 3) mm", 3, "2.5 - 3"), ("7", 1, None), ("none", 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "t string, p int, want string")
    assert [r[0] for r in df.select(textmine.number_near("t", "p")).collect()] == [r[2] for r in rows]


def test_text_rules(spark):
    df = spark.createDataFrame([("caf\u00e9 5\u00b5m\x07\tx \n y",), (None,)], "t string")
    out = df.select(textmine.cleaned("t").alias("c"), textmine.collapsed("t"), textmine.thinned(F.lit("a  b c")), textmine.decimal_point(F.lit("1,5"))).collect()
    assert out[0]["c"] == "caf? 5?m? x   y" and out[0][1] == "caf\u00e9 5\u00b5m\x07 x y" and out[0][2] == "a bc" and out[0][3] == 1.5 and out[1]["c"] is None
    parts = spark.createDataFrame([("Apis mellifera",), ("Apis mellifera ligustica",), ("Apis",)], "t string").select(*textmine.name_parts("t")).collect()
    assert [tuple(r) for r in parts] == [("Apis", "mellifera"), ("Apis", "mellifera ligustica"), ("Apis", "")]
    words = spark.createDataFrame([("w " * 160, "first", "second"), ("abc " * 160, "first", "second"), ("short", "first", "second")], "s string, a string, b string")
    assert [tuple(r) for r in words.select(*textmine.routed("s", "a", "b")).collect()] == [("first", False), ("first", False), ("second", True)]
    assert spark.range(1).select(textmine.keyword_position(F.lit("long egg"), ["egg", "long"])).first()[0] == 6


def test_words_count_in_lower_case(spark):
    docs = spark.createDataFrame([(1, "fooBar " * 4 + "foobar " * 3 + "other words here"), (2, "foobar fooBar x")], "i long, t string")
    got = textmine.distinctive_terms(docs, "i", "t", textmine.corpus_frequencies(docs, "t")).collect()
    assert [(r["word"], r["n"]) for r in got] == [("foobar", 7)] and got[0]["rel"] == pytest.approx(7 / 10 / (9 / 13))


def test_unique_references(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "xa"), (4, "x"), (5, None)] + [(10 + i, "y") for i in range(15)], "o long, i string")
    got = {r["o"]: r["u"] for r in keys.unique_references(new, spark.createDataFrame([("xab",)], "i string"), "i", "o", "u").collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["x", "xabc", "xa", "xabcd"] and got[5] is None
    ladder = [got[10 + i] for i in range(15)]
    assert ladder[:3] == ["y", "ya", "yab"] and ladder[13:] == [None, None]
    whole = [v for v in got.values() if v]
    assert len(whole) == len(set(whole))


def test_other_data_set(spark):
    got = spark.range(1).select(*[v.alias(k) for k, v in measures.converted(F.lit(2.0), F.lit(0.25), F.lit(0.5)).items()]).first()
    assert got["length_mm"] == 20 and got["width_mm"] == 16 and got["asymmetry"] == pytest.approx(0.5 ** (-0.5 / 2.5) * 1.5 ** (0.5 / 2.5) - 1)


def test_large_clades_and_state_changes(spark):
    edges = spark.createDataFrame([("t", "r", "a", 1.0), ("t", "r", "b", 1.0), *[("t", "a", f"a{i}", 1.0) for i in range(3)], ("t", "b", "b0", 1.0), ("t", "b", "b1", 1.0), ("t", "a", "c", 1.0), ("t", "c", "c0", 1.0)], EDGES)
    parts = hierarchy.clades(edges, 4)
    families = spark.createDataFrame([("a0", "F"), ("a1", "G"), ("b0", "G"), ("c0", "H")], "node string, family string")
    assert [tuple(r) for r in hierarchy.large_clades(parts, 2).collect()] == [("t", "a", 4)]
    assert sorted(tuple(r) for r in hierarchy.own_families(parts, families).collect()) == [("t", "a", "F"), ("t", "a", "H")]
    orders = spark.createDataFrame([("a0", "O"), ("b0", "P")], "node string, order1 string")
    assert sorted((r["clade"], r["tip"], r["label"]) for r in hierarchy.representatives(parts, orders).collect()) == [("a", "a0", "a_O"), ("b", "b0", "b_P")]
    states = spark.createDataFrame([("t", x, int(x in ("a", "a0", "a1", "c", "b1"))) for x in ("r", "a", "b", "a0", "a1", "a2", "c", "c0", "b0", "b1")], "tree_id string, node string, state int")
    got = sorted((r["node"], r["change"], r["tips"], r["nodes"]) for r in hierarchy.state_changes(edges, states).collect())
    assert got == [("a", 1, 4, 1), ("a2", -1, 1, 0), ("b1", 1, 1, 0), ("c0", -1, 1, 0)]
    tips = sorted((r["node"], r["change"], r["tip"]) for r in hierarchy.tips_of_changes(edges, states).collect())
    assert tips == [*[("a", 1, x) for x in ("a0", "a1", "a2", "c0")], ("a2", -1, "a2"), ("b1", 1, "b1"), ("c0", -1, "c0")]


def test_best_effort_pairing(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", None), (4, "z", 4.0), (5, "", 5.0)], "id long, name string, v double")
    b = spark.createDataFrame([(1, "x", 9.0), (2, "y", 8.0), (3, "x", 7.0), (4, "z", 6.0)], "id long, name string, w double")
    rows = classify.paired(a, b, "name", "id", ["v"], ["w"], 3).collect()
    assert sorted(r["name"] for r in rows) == ["x", "z"] and all(r["v"] is not None and r["w"] is not None for r in rows)
    assert sorted(classify.paired(a, b, "name", "id", ["v"], ["w"], 3).collect()) == sorted(rows)


def test_corrections_by_reference_and_taxon(spark):
    df = spark.createDataFrame([({"ID": "1", "b": "r1", "g": "Apis", "s": "mel"},), ({"ID": "2", "b": "r1", "tax_matched": "Bombus x"},), ({"ID": "3", "b": "r2", "g": "Apis", "s": "mel"},)], "e map<string,string>")
    fix = spark.createDataFrame([("r1", "Apis_mel", "al", "3"), ("r1", "Bombus x", "al", "4")], "b string, taxon string, key string, new_value string")
    got = {r["e"]["ID"]: r["e"].get("al") for r in clean.corrected_by_taxon(df, "e", fix).collect()}
    assert got == {"1": "3", "2": "4", "3": None}


def test_swapped_halves(spark):
    df = spark.createDataFrame([({"al": "1", "dl": "2", "mw": "5", "xw": "4", "ab": "3", "db": "1"},)], "e map<string,string>")
    assert df.select(clean.in_order("e").alias("e")).first()["e"] == {"al": "2", "dl": "1", "mw": "4", "xw": "5", "ab": "3", "db": "1"}


def test_repeated_fields_of_references(spark, tmp_path):
    (tmp_path / "b.bib").write_text("@article{x1,\n author={A},\n author={B},\n year = {1999},\n title={T}\n}\n@book{x1,\n title = {last}\n}\n")
    refs = files.read_references(spark, str(tmp_path / "b.bib"))
    assert [r["fields"] for r in refs.collect()] == [{"author": "B", "year": "1999", "title": "T"}, {"title": "last"}]
    assert [(r["bib_id"], r["fields"]) for r in files.last_reference(refs).collect()] == [("x1", {"title": "last"})]


def test_number_pairs(spark):
    df = spark.createDataFrame([("1,5 x 2", "p"), ("1.5 +- 0.2", "a"), ("3 - 4", "m"), ("7", "x"), ("no", "p")], "t string, m string")
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in df.select(*[v.alias(k) for k, v in textmine.number_pair("t", "m").items()]).collect()]
    assert got == [{"point_length": 1.5, "point_width": 2.0}, {"mean": 1.5, "deviation": 0.2}, {"least": 3.0, "most": 4.0}, {"most": 7.0}, {}]


def test_cleaning_flags(spark):
    rows = [({"al": " 5  ", "dl": "", "b": "r", "g": "G"},), ({"al": "5", "odd": "0.5", "b": "r", "g": "G"},), ({"al": "50", "dl": "60", "xl": "1", "b": "r"},), ({"tax_x": "1", "problem": "y", "i": "p"},)]
    df = spark.createDataFrame(rows, "e map<string,string>").select(clean.rinsed("e").alias("e"))
    got = df.select(clean.lone_halves("e"), clean.unexpected("e"), clean.suggestion("e"), clean.conflicting("e"), clean.disordered("e"), clean.out_of_range("e"), clean.missing_keys("e"), clean.measured("e")).collect()
    assert got[0][0] == ["al"] and got[1][1] == ["odd"] and tuple(got[1][2]) == ("dl", "0.5")
    assert got[2][3] == ["l"] and got[2][4] == ["l"] and sorted(got[2][5]) == ["al", "dl"] and got[2][6] == ["g"]
    assert got[3][1] == [] and got[3][7]


def test_corrections(spark):
    df = spark.createDataFrame([({"ID": "1", "al": "2"},), ({"ID": "2"},)], "e map<string,string>")
    fix = spark.createDataFrame([("1", "al", "3")], "ID string, key string, new_value string")
    got = {r["e"]["ID"]: r["e"] for r in clean.corrected(df, "e", fix).collect()}
    assert got["1"] == {"ID": "1", "al": "3", "dbl_chk": "y"} and got["2"] == {"ID": "2"}


def test_ids_are_compared_as_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    got = keys.numbered(df, ["k"], spark.createDataFrame([("9",), ("10",)], "i string"), "i", "n")
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 11, "b": 12}


def test_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("{'ID': '1', 'al': '2'}\n{u'g': \"O'Neil\"}\nnot a record\n")
    got = {r["line"]: (r["entry"], r["bad"]) for r in files.read_entries(spark, str(tmp_path / "e.txt")).collect()}
    assert got["{u'g': \"O'Neil\"}"] == ({"g": "O'Neil"}, False) and got["not a record"] == (None, True)
    (tmp_path / "b.bib").write_text("@article{x1,\n author={A, B},\n year = {1999}\n}\n@book{y2,\n title = {T {X}}\n}\n")
    got = {r["bib_id"]: r for r in files.read_references(spark, str(tmp_path / "b.bib")).collect()}
    assert got["x1"]["fields"] == {"author": "A, B", "year": "1999"} and got["y2"]["kind"] == "book" and not got["y2"]["bad"]
    (tmp_path / "d.txt").write_text("a1\nb2 : #NO pdf\n")
    assert [tuple(r) for r in files.read_done(spark, str(tmp_path / "d.txt")).collect()] == [("a1", None), ("b2", "NO pdf")]
    (tmp_path / "t.tsv").write_text("n\tt\n1.50\tNA\n\tx\n")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.tsv"), "n double, t string").collect()] == [(1.5, None), (None, "x")]


def test_stream_appends_only_new_lines(spark, tmp_path):
    known, into = str(tmp_path / "known"), tmp_path / "a_data"
    spark.createDataFrame([("a", "{1}")], "order1 string, line string").write.parquet(known)
    into.mkdir()
    (into / "x.txt").write_text("{1}\n{2}\nnone\n")
    stream = ingest.line_stream(spark, str(into), r"([a-z]+)_data")
    ingest.load_new(stream, known, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["line"] for r in spark.read.parquet(known).collect()) == ["{1}", "{2}"]


def star(n, rng):
    return [("t", "root", f"k{i}", 1.0) for i in range(n)], [("t", "f", f"k{i}", rng.random(), rng.random()) for i in range(n)]


EDGES, TIPS = "tree_id string, parent string, child string, length double", "tree_id string, fit string, node string, x double, y double"


def test_star_tree_equals_plain_regression(spark):
    edges, tips = star(12, random.Random(1))
    df = spark.createDataFrame(tips, TIPS)
    got = regress.along_tree(spark.createDataFrame(edges, EDGES), df).first()
    want = df.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    assert got["slope"] == pytest.approx(want[0]) and got["intercept"] == pytest.approx(want[1]) and 0 <= got["p"] <= 1
    moved = regress.along_tree(spark.createDataFrame(edges, EDGES), df.withColumn("y", F.col("y") + 5)).first()
    assert moved["slope"] == pytest.approx(got["slope"]) and moved["intercept"] == pytest.approx(got["intercept"] + 5)


def test_single_child_nodes_and_missing_tips(spark):
    edges = [("t", "r", "a", 1.0), ("t", "a", "b", 2.0), ("t", "b", "x", 0.5), ("t", "b", "y", 0.5), ("t", "r", "z", 1.0), ("t", "r", "w", 0.0)]
    tips = [("t", "f", "x", 1.0, 2.0), ("t", "f", "y", 2.0, 1.0), ("t", "f", "z", 3.0, 5.0)]
    e, d = spark.createDataFrame(edges, EDGES), spark.createDataFrame(tips, TIPS)
    whole = treefold.fold(e, d).first()
    less = treefold.fold(hierarchy.pruned(e, d.select("tree_id", "node")), d).first()
    assert whole["slope"] == pytest.approx(less["slope"]) and whole["logdet"] == pytest.approx(less["logdet"]) and whole["n"] == 3
    assert {r["node"]: r["height"] for r in hierarchy.heights(e).collect()} == {"x": 0, "y": 0, "z": 0, "w": 0, "b": 1, "a": 2, "r": 3}


def test_heights_of_deep_tree(spark):
    e = spark.createDataFrame([("t", f"k{i}", f"k{i + 1}", 1.0) for i in range(68)], EDGES).coalesce(1)
    assert {r["node"]: r["height"] for r in hierarchy.heights(e).collect()} == {f"k{i}": 68 - i for i in range(69)}


def ladder(n, rng):
    """A path of n nodes with a tip at each and one more at its end, its tip rows, and the tips' covariance."""
    import numpy as np

    edges = [("t", f"k{i}", f"k{i + 1}", rng.uniform(0.5, 2)) for i in range(n - 1)]
    edges += [("t", f"k{i}", f"t{i}", rng.uniform(0.5, 2)) for i in range(n)] + [("t", f"k{n - 1}", f"t{n}", 1.0)]
    tips = [("t", "f", f"t{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n + 1)]
    depth = np.cumsum([0.0, *(v for *_, v in edges[: n - 1])])  # of k0, k1, ...
    at = [min(i, n - 1) for i in range(n + 1)]
    return edges, tips, np.array([[depth[min(a, b)] for b in at] for a in at]) + np.diag([length for *_, length in edges[n - 1 :]])


@pytest.mark.parametrize("n, most", [(3, 0), (70, 10_000), (500, 10_000)])
def test_ladder_tree_equals_dense_least_squares(spark, n, most):
    import numpy as np

    edges, tips, v = ladder(n, random.Random(3))
    e = spark.createDataFrame(edges, EDGES).coalesce(1)
    got = treefold.fold(e, spark.createDataFrame(tips, TIPS), most=most).collect()
    x, y, inverse = np.array([[1.0, r[3]] for r in tips]), np.array([r[4] for r in tips]), np.linalg.inv(v)
    intercept, slope = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    assert [r["n"] for r in got] == [n + 1]
    assert got[0]["slope"] == pytest.approx(slope) and got[0]["intercept"] == pytest.approx(intercept) and got[0]["logdet"] == pytest.approx(np.linalg.slogdet(v)[1])


def test_folds_in_tasks_and_by_levels_agree(spark):
    rng = random.Random(8)
    edges, tips = [], []
    for t in "ab":
        kids = {f"{t}0"}
        for i in range(1, 60):
            p = f"{t}{rng.randrange(min(i, 1 if i < 4 else 4))}"
            edges.append((t, p, f"{t}{i}", rng.choice([0.0, 0.5, 1.5])))
            kids = (kids | {f"{t}{i}"}) - {p}
        inner = {p for _, p, _, _ in edges}
        tips += [(t, f, x, rng.random(), rng.random()) for f in ("f", "g") for x in sorted(kids - inner) if rng.random() < 0.8]
    e, d = spark.createDataFrame(edges, EDGES), spark.createDataFrame(tips, TIPS)
    one = {(r["tree_id"], r["fit"]): r for r in treefold.fold(e, d).collect()}
    two = {(r["tree_id"], r["fit"]): r for r in treefold.fold(e, d, most=0).collect()}
    assert len(one) == 4 and set(one) == set(two)
    for k, r in one.items():
        assert all(r[c] == pytest.approx(two[k][c]) for c in ("slope", "intercept", "sxx", "sxy", "syy", "logdet", "n"))


def test_cycles_raise(spark):
    for rows in ([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], [("t", "a", "b", 1.0), ("t", "b", "c", 1.0), ("t", "c", "a", 1.0), ("t", "c", "x", 1.0)]):
        e = spark.createDataFrame(rows, EDGES)
        for f in (hierarchy.heights, hierarchy.ancestors):
            with pytest.raises(ValueError):
                f(e)


def test_shifts(spark):
    edges = spark.createDataFrame([("t", "r", "a", 1.0), ("t", "a", "b", 1.0), ("t", "b", "c", 1.0), ("t", "r", "d", 1.0)], EDGES)
    states = spark.createDataFrame([("t", "r", 0), ("t", "a", 1), ("t", "b", 1), ("t", "c", 0), ("t", "d", 0)], "tree_id string, node string, state int")
    assert {r["node"]: r["shift"] for r in hierarchy.shifts(edges, states).collect()} == {"r": None, "a": "a", "b": "a", "c": "c", "d": None}


def test_student_tail():
    import numpy as np

    got = regress.student_tail(np.array([0.0, 1.0, 2.0, 12.706204736]), np.array([5.0, 1.0, 10.0, 1.0]))
    assert got == pytest.approx([1.0, 0.5, 0.0733880, 0.05], abs=1e-6) and math.isfinite(got.sum())


def test_hulls_hold_all_points(spark):
    rng = random.Random(5)
    rows = [(g, rng.gauss(0, 1), rng.gauss(0, 1)) for g in ("a", "b") for _ in range(300)] + [("one", 1.0, 2.0), ("one", 1.0, 2.0), (None, 0.0, 0.0), (None, 1.0, 1.0), (None, 2.0, 2.0), ("bad", float("nan"), 1.0), ("bad", None, 1.0)]
    got = hulls.convex_hulls(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()
    of = {g: [(r.x, r.y) for r in sorted(got, key=lambda r: r.place) if r.g == g] for g in {r.g for r in got}}
    assert set(of) == {"a", "b", "one", None} and of["one"] == [(1.0, 2.0)] and of[None] == [(0.0, 0.0), (2.0, 2.0)]
    for g in ("a", "b"):
        edges = list(zip(of[g], of[g][1:] + of[g][:1], strict=True))
        assert set(of[g]) <= {(x, y) for h, x, y in rows if h == g}
        assert all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -1e-12 for p, q in edges for h, x, y in rows if h == g)


def test_tree_models_equal_dense_likelihoods(spark):
    import numpy as np

    edges = [("r", "a", 1.0), ("r", "b", 2.0), ("a", "t1", 3.0), ("a", "t2", 3.0), ("b", "t3", 2.0), ("b", "c", 1.0), ("c", "t4", 1.0), ("c", "t5", 1.0), ("r", "t6", 4.0)]
    tips, y = ["t1", "t2", "t3", "t4", "t5", "t6"], np.array([1.0, 2.5, 0.5, 3.0, 2.0, 4.0])
    shared = np.zeros((6, 6))
    up = {c: (p, v) for p, c, v in edges}

    def path(n):
        return [] if n == "r" else [n, *path(up[n][0])]

    for i, s in enumerate(tips):
        for j, t in enumerate(tips):
            shared[i, j] = sum(up[n][1] for n in set(path(s)) & set(path(t)))
    eye = np.eye(6, dtype=bool)
    dense = {
        ("brownian", 0.0): shared, ("white", 0.0): np.eye(6), ("lambda", 0.5): np.where(eye, shared, shared * 0.5),
        ("early", -0.2): (np.exp(-0.2 * shared) - 1) / -0.2, ("pull", 0.3): (np.exp(-0.6 * (4 - shared)) - np.exp(-0.6 * 4)) / 0.6,
    }
    e = spark.createDataFrame([("x", *r) for r in edges], "tree_id string, parent string, child string, length double")
    traits = spark.createDataFrame([("x", "y", t, float(v)) for t, v in zip(tips, y, strict=True)], "tree_id string, trait string, node string, y double")
    fits = treemodels.model_fits(e, traits, {"lambda": [0.5], "early": [-0.2], "pull": [0.3]})
    got = {(r.model, r.value): r for r in fits.collect()}
    assert set(got) == set(dense)
    for key, v in dense.items():
        inverse, one = np.linalg.inv(v), np.ones(6)
        rest = y - (one @ inverse @ y) / (one @ inverse @ one)
        loglik = -0.5 * (6 * (math.log(2 * math.pi) + math.log(rest @ inverse @ rest / 6) + 1) + np.linalg.slogdet(v)[1])
        assert got[key].loglik == pytest.approx(loglik, abs=1e-6)
    best = treemodels.best_models(fits).first()
    assert best.aicc == min(r.aicc for r in got.values())


def test_fan_out_and_missing_sides(spark):
    a = spark.createDataFrame([("g", 1), ("h", 2), ("i", 1)], "genus string, state int")
    b = spark.createDataFrame([("g", 1), ("g", 2), ("h", 2)], "genus string, state int")
    assert sorted(map(tuple, reports.three_states(a, b, "genus", "state").collect())) == [("g", 3), ("h", 2), ("i", 1)]
    assert reports.three_states(a, b, "genus", "state", fan_out=True).count() == 4
    groups = b.withColumnRenamed("state", "size")
    assert reports.with_groups(a, groups, "genus").count() == 3 and reports.with_groups(a, groups, "genus", fan_out=True).count() == 4
    rows = reports.progress(a, a.limit(0).withColumn("mark", F.lit("")), a.withColumn("sp", F.lit(None).cast("string")), "genus", "mark", "genus", "sp").collect()
    assert {r.genus: r.examined for r in rows} == {"g": "-", "h": "-", "i": "-", "total": "-"}


def test_wrong_orders_change_places(spark):
    e = {"al": "1", "dl": "2.5", "ml": "3", "xl": "4", "mw": "9", "xw": "x", "db": "1", "ab": "1", "g": "z"}
    df = spark.createDataFrame([(e,), ({},), (None,)], "e map<string,string>")
    out = [r[0] for r in df.select(clean.in_order("e")).collect()]
    assert out == [e | {"al": "2.5", "dl": "1"}, {}, None]


def test_groups_with_nulls_and_stacks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0)], "k string, v double")
    sizes = {(r["k"], r["v"]): (r["group_n"], r["group_min"], r["group_max"]) for r in stats.with_group_size(df, "k", "v").collect()}
    assert sizes == {("a", 1.0): (2, 1.0, 1.0), ("a", None): (2, 1.0, 1.0), (None, 5.0): (1, 5.0, 5.0)}
    assert [tuple(r) for r in stats.frequencies(df, ["k"]).collect()] == [("a", 2, 2 / 3), (None, 1, 1 / 3)]
    assert stats.frequencies(df.limit(0), ["k"]).count() == 0
    both = measures.stacked(df, spark.createDataFrame([(7, "a")], "w int, k string"))
    assert both.columns == ["k", "v", "w"] and both.where("w = 7 and v is null and k = 'a'").count() == 1
    kept = measures.without_pairs(spark.createDataFrame([("x", "y"), ("x", None), (None, None)], "a string, b string"), "a", "b", [("x", "y")])
    assert {tuple(r) for r in kept.collect()} == {("x", None), (None, None)} and kept.count() == 2
    ranked = measures.by_levels(spark.createDataFrame([("b", 1), ("z", 2), ("a", 3), ("b", 4), (None, 5)], "g string, n int"), "g", ["b", "a"], F.desc("n")).collect()
    assert [r["n"] for r in ranked] == [4, 1, 3, 5, 2] and [r["level"] for r in ranked] == [1, 1, 2, None, None]


def test_cascade_joins_states_of_one_name(spark):
    rules = spark.createDataFrame([("order", "O", "1"), ("family", "F", "1"), ("family", "F", "2"), ("family", "G", "3")], "rank string, name string, state string")
    rows = spark.createDataFrame([(1, "O", "F"), (2, "O", "x"), (3, "x", "G"), (4, None, None)], "id int, order string, family string")
    out = classify.cascade(rows, rules, ["order", "family"], {"1": "one", "2": "both", "3": "three"}, "none", "kind").orderBy("id").collect()
    assert [r["kind"] for r in out] == ["both", "one", "three", "none"]


def test_bootstrap_shares(spark):
    simulated = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (2, "a", 5.0), (2, "b", 1.0), (3, "a", 0.0), (3, "b", 9.0)], "rep int, key string, v double")
    observed = spark.createDataFrame([("a", 4.0), ("a", 9.0), ("b", 2.0)], "key string, v double")
    assert tuple(stats.joint_tail_share(simulated, observed, "rep", "key", "v").first()) == (3, pytest.approx(1 / 3))
