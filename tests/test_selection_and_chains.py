"""Order statistics, samples, the positional index, the mining chain, clips, lineages and cleaning on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import classify, clean, dedup, keys, measures, select, stats, textmine


def test_quantiles_of_many_groups(spark):
    rng = random.Random(7)
    rows = [(None if k == 3 else f"k{k}", rng.choice([None, float(rng.randrange(20)), rng.gauss(0, 1)])) for k in range(5) for _ in range(200 if k == 0 else 1 + 7 * k)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["k"]: r for r in select.quantiles(df, ["k"], "v", shares).collect()}
    of = {}
    for k, v in rows:
        if v is not None:
            of.setdefault(k, []).append(v)
    assert set(got) == set(of) and "none" not in got
    for k, values in of.items():
        assert got[k]["n"] == len(values) and [got[k][x] for x in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()])
    whole = select.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r["m"] for r in whole] == [pytest.approx(np.median([v for _, v in rows if v is not None]))]
    assert [tuple(r) for r in select.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()] == [(None, None)] and measures.trim_above(df.limit(0), "v", 0.5).count() == 0
    assert {r["what"]: (r["low"], r["high"]) for r in stats.interval(spark.createDataFrame([(1.0, None), (3.0, None)], "p double, q double"), ["p", "q"], 0.0, 1.0).collect()} == {"p": (1.0, 3.0)}


def test_a_group_of_most_rows_spreads_over_tasks(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    seen = select.at_ranks(df, ["k"], "v", lambda n: {"m": n / 2})
    assert [(r["n"], r["m"]) for r in seen.collect()] == [(40_000, 20_000.0)]
    parts = df.repartitionByRange(8, "k", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 10_000


def test_samples_and_newest_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").when(F.col("id") < 4990, "small").alias("k"), "id")
    got = {r["k"]: r["count"] for r in dedup.sample_fraction(df, "k", "id", 0.25, 3).groupBy("k").count().collect()}
    assert got == {"hot": 1125, "small": 123, None: 3}
    assert sorted(r["id"] for r in dedup.sample_fraction(df, "k", "id", 0.25, 3).collect()) == sorted(r["id"] for r in dedup.sample_fraction(df.repartition(7), "k", "id", 0.25, 3).collect())
    assert dedup.sample_fraction(df, "k", "id", 0.0, 3).count() == 0 and dedup.sample_fraction(df, "k", "id", 1.0, 3).count() == 5000
    rows = [("a", 1.0, 2000, 1), ("a", 1.0, 2001, 3), ("a", 1.0, 2001, 2), ("b", 1.0, None, 5), ("b", 1.0, None, 4), ("c", 1.0, 1, 6), ("c", 2.0, 2, 7), ("d", None, 1, 8), ("d", 1.0, 1, 9), (None, 1.0, 1, 10), (None, 1.0, 2, 11)]
    kept = dedup.newest_of_repeats(spark.createDataFrame(rows, "name string, v double, y int, i int"), "name", "v", "y", "i").collect()
    assert sorted(r["i"] for r in kept) == [2, 4, 6, 7, 8, 9, 10, 11]


def test_tied_references_differ(spark):
    new = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("x", 1)], "id string, o int")
    got = sorted(r["unique_id"] for r in keys.unique_references(new, new.limit(0), "id", "o").collect())
    assert got == ["x", "xa", "xab", "xabc"]


def test_endings_are_tested_in_lower_case(spark):
    docs = spark.createDataFrame([(1, "fooboX " * 6 + "barbaQ " * 6 + "Foobox " * 6), (2, "")], "i long, t string")
    assert [(r["word"], r["n"]) for r in textmine.distinctive_terms(docs, "i", "t", spark.createDataFrame([], "word string, freq double")).collect()] == [("foobox", 6)]


def test_spellings_are_stripped_once_each(spark):
    docs = spark.createDataFrame([(1, "magna " * 7 + "(Magna) " * 2 + "genus " * 6), (2, "-- magna\n")], "i long, t string")
    terms = textmine.distinctive_terms(docs, "i", "t", textmine.corpus_frequencies(docs, "t"))
    # A condition on words must not take the stripping to every occurrence; counts of words are read, not taken again.
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("Generate explode") == 1
    assert [(r["word"], r["n"], round(r["rel"], 6)) for r in terms.orderBy("place").collect()] == [("genus", 6, round(17 / 15, 6)), ("magna", 7, round(7 / 15 / (10 / 17), 6))]


def test_rows_that_count_their_own_words(spark):
    rng = random.Random(5)
    parts = ["magna", "magNa", "Magna", "genuS", "genus,", "maxim", "minor", "xminor", "minorZ", "é", "größe", "😀minor", "minor😀", "ma", "a1magna", "--", "seriesx"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "\t \r", "\x0b", "\x0c"]) for _ in range(rng.randrange(150))) for _ in range(40)] + ["", None, "magna " * 5, "magna " * 6, " magna" * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("k", F.size(textmine.word_list("t")))
    corpus = textmine.corpus_frequencies(docs, "t")
    slow, fast = (textmine.distinctive_terms(docs, "i", "t", corpus, **more) for more in ({}, {"words": "k"}))
    rows = sorted(tuple(r) for r in slow.collect())
    assert len(rows) > 40 and rows == sorted(tuple(r) for r in fast.collect())


def test_windows_equal_a_scan_of_all(spark):
    rng = random.Random(3)
    parts = [t for group, _ in textmine.TERMS for t in group] + ["mmm", "1", "12", "x" * 30, " ", "é𝒳", "eg", "3 4 5 6"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.3 else "z" * rng.randrange(60) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += ["", None, "egg", "z" * 400, "z" * 399 + "egg", "egg" + "z" * 417, "1234" + "z" * 400, "m" * 500, "z" * 396 + "12345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: (r["start"], r["score"]) for r in textmine.best_windows(docs, "i", "t").collect()}

    def score(s):
        return sum(w for group, w in textmine.TERMS if any(t in s for t in group)) + 2 * (sum(c in "0123456789" for c in s) > 3)

    for i, text in enumerate(texts):
        scores = [(score(text[k * 20 : k * 20 + 400]), -k * 20) for k in range(len(text) // 20)] if text and len(text) >= 400 else []
        best = max(scores, default=(0, 0))
        assert got.get(i) == ((-best[1], best[0]) if best[0] > 0 else None), text


def test_chain_takes_every_route(spark):
    long = "Word " * 30 + "alpha " * 160
    rows = [
        (1, long + "Daphnia magna " + "magna " * 7 + "egg length 3.5 mm and wide 2,5 " + "z " * 300),
        (2, " ".join("".join(c + " " for c in w) for w in ["egg", "length", "9", "mm", "word"] * 40)),
        (3, "tiny"),
        (4, long + "mature oocyte 12345 " + "q " * 300),
        (5, long + " egg long " + "q " * 300),
        (6, None),
    ]
    docs = spark.createDataFrame(rows, "i long, t string").withColumns({"p": F.substring("t", 1, 3000), "u": F.lit("second source")})
    got = {r["i"]: r for r in textmine.mine_corpus(docs, "i", "p", "t", "u", {"length": ["length", "long"], "width": ["wide"]}).collect()}
    assert {i: r["route"] for i, r in got.items()} == {1: "first", 2: "thinned", 3: "second", 4: "first", 5: "first", 6: "second"}
    assert {i: r["status"] for i, r in got.items()} == {1: "mined", 2: "mined", 3: "no window", 4: "no keyword", 5: "no number", 6: "no window"}
    assert got[1]["length_number"] == "3.5" and got[1]["width_number"] == "2,5" and (got[1]["first_name"], got[1]["second_name"]) == ("Daphnia", "magna")
    assert got[3]["low_text"] and got[6]["low_text"] and not got[1]["low_text"]


def test_clips_of_a_record(spark):
    rows = [("r", 1, "p", "l", "1,5 x 2"), ("r", 2, "a", "l", "3 +- 0.5"), ("r", 3, "a", "l", "4"), ("r", 4, "m", "w", "1 - 2"), ("r", 4, "x", "w", "0 - 9"), ("r", 5, "d", "b", None), ("r", 6, None, "b", "1"), ("s", 1, "x", "b", "none"), ("t", 1, "p", "b", None)]
    got = {r["i"]: r["entry"] for r in textmine.merged_clips(spark.createDataFrame(rows, "i string, o int, m string, s string, t string"), "i", "o", "m", "s", "t").collect()}
    assert got == {"r": {"pl": "1.5", "pw": "2", "al": "4", "dl": "0.5", "mw": "1", "xw": "9"}, "s": {"xb": "none"}}


def test_lineages_with_gaps_and_conflicts(spark):
    rows = [("O", "F", "g", "t1"), ("O", "F", "g", "t1"), ("O", "G", "g", "t2"), ("O", "E", "g", "t3"), ("O", None, "h", "t4"), (" ", "", "h", "t4"), (None, None, None, "t5")]
    df = spark.createDataFrame(rows, "ord string, fam string, gen string, tip string")
    got = {(r["rank"], r["taxon"]): tuple(r)[2:] for r in classify.lineage_counts(df, ["ord", "fam", "gen"], "tip", spark.createDataFrame([("gen", "g", 9)], "rank string, taxon string, total int")).collect()}
    assert got["gen", "g"] == ("fam", "F", 3, 4, 3, 9) and got["gen", "h"] == ("ord", "O", 1, 2, 1, None)
    assert got["ord", "O"] == (None, None, 0, 5, 4, None) and got["fam", "E"] == ("ord", "O", 1, 1, 1, None) and len(got) == 6
    assert [r[0] for r in classify.sorted_taxa(df, ["ord", "fam", "gen"]).collect()] == ["E", "F", "G", "O", "g", "h"]


def test_cleaning_checks_corrects_and_checks_again(spark):
    whole = {"b": "r", "g": "G", "al": "5", "dl": "1"}
    rows = [whole | {"ID": "1"}, {"ID": "2", "g": "G", "al": "5", "dl": "1"}, whole | {"ID": "3", "dl": "9"}, {"ID": "4", "b": "r", "g": "G", "al": "5", "odd": "2"}, whole | {"ID": "5", "al": "99"}, {"ID": "6"}, whole | {"ID": "7", "al": "x", "cln": "sqky"}]
    df = spark.createDataFrame([(r,) for r in rows], "e map<string,string>")
    good, bad, counts = clean.cleaning_loop(df, "e", spark.createDataFrame([("2", "b", "q"), ("9", "b", "q")], "ID string, key string, new_value string"))
    assert {r["e"]["ID"]: (r["before"], r["e"].get("al"), r["e"].get("dl")) for r in good.collect()} == {"1": ("sqky", "5", "1"), "2": ("rnsd", "5", "1"), "3": ("cols", "9", "5"), "4": ("rnsd", "5", "2"), "7": ("sqky", "x", "1")}
    assert {r["e"]["ID"]: (r["status"], r["failing"]) for r in bad.collect()} == {"5": ("cols", ["out of range"]), "6": ("rnsd", ["required key", "nothing measured"])}
    assert counts == {"records": 7, "good before": 2, "corrected": 1, "good after": 5, "quarantined": 2}
    points = df.select(clean.as_point("e").alias("p"), clean.dimension_is_good("e", "l").alias("good")).collect()
    assert points[3]["p"]["pl"] == "5" and "al" not in points[3]["p"] and [r["good"] for r in points] == [True, True, True, False, True, False, True]


