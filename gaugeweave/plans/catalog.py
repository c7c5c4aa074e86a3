"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The driver's tables stand in for measurements: a line item's quantity is a length, its discount and tax make widths, and
each kind of estimate is missing for some rows by its key, so that every branch of a cascade occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir
from ..functions.nulls import finite, log10
from ..operators import classify, clean, dedup, hierarchy, hulls, keys, measures, regress, reports, stats, textmine, treefold, treemodels
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "measure_summary"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of length and width per line item, with part attributes."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    q = F.col("l_quantity")
    return items.join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "p_brand", "p_type", "p_size", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        F.when(k % 5 != 0, q).alias("al"), F.when(k % 3 == 0, q * 0.8).alias("ml"), F.when(k % 7 != 0, q * 1.2).alias("xl"), F.when(k % 2 == 0, q + 1).alias("pl"),
        ((F.col("l_tax") + 0.01) * 100).alias("w"), F.when(k % 4 == 0, (F.col("l_discount") + 0.01) * 100).alias("b"),
    )


_RAW = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, p_brand, p_type, p_size, l_extendedprice, l_discount, l_tax, l_shipdate,
    CASE WHEN k % 5 <> 0 THEN q END AS al, CASE WHEN k % 3 = 0 THEN q * 0.8::DOUBLE END AS ml, CASE WHEN k % 7 <> 0 THEN q * 1.2::DOUBLE END AS xl,
    CASE WHEN k % 2 = 0 THEN q + 1 END AS pl, (l_tax + 0.01::DOUBLE) * 100 AS w, CASE WHEN k % 4 = 0 THEN (l_discount + 0.01::DOUBLE) * 100 END AS b
  FROM (SELECT *, l_orderkey + l_linenumber AS k, l_quantity AS q FROM lineitem) JOIN part ON l_partkey = p_partkey),
m AS (
  SELECT *, CASE WHEN al IS NOT NULL THEN al WHEN ml IS NOT NULL THEN xl - (xl - ml) / 2 ELSE pl END AS len,
    greatest(w, b) AS wide, CASE WHEN b IS NOT NULL THEN least(w, b) END AS narrow FROM raw)
"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, narrow = measures.axes("w", "b")
    return _raw(spark, sf_dir).withColumns({"len": measures.estimate("al", "ml", "xl", "pl"), "wide": wide, "narrow": narrow})


@query(_RAW + """, t AS (
  SELECT *, len / wide AS ratio FROM m), u AS (
  SELECT * FROM t WHERE ratio IS NULL OR ratio < (SELECT quantile_cont(ratio, 0.999) FROM t))
SELECT coalesce(grp, p_brand) AS grp, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(avg(len), 6) AS mean_len
FROM u LEFT JOIN (VALUES ('Brand#11', 'first'), ('Brand#12', 'first'), ('Brand#21', 'second')) d(brand, grp) ON p_brand = brand GROUP BY 1
""")
def measure_summary(spark, sf_dir):
    """Estimate cascade, derived ratio, quantile trim, dictionary lookup, grouped mean."""
    rows = _measured(spark, sf_dir).withColumn("ratio", measures.ratio("len", "wide"))
    groups = spark.createDataFrame([("Brand#11", "first"), ("Brand#12", "first"), ("Brand#21", "second")], "brand string, grp string")
    named = classify.lookup(measures.trim_above(rows, "ratio", 0.999), groups, "p_brand", "brand", "grp", "grp")
    return named.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.avg("len"), 6).alias("mean_len"))


@query(_RAW + "SELECT l_orderkey, l_linenumber, round(len, 6) AS len, round(wide, 6) AS wide, round(narrow, 6) AS narrow FROM m")
def estimate_cascade(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _measured(spark, sf_dir).select("l_orderkey", "l_linenumber", r("len"), r("wide"), r("narrow"))


@query(_RAW + """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN narrow IS NOT NULL THEN 4 / 3.0::DOUBLE * pi() * (len / 2) * (wide / 2) * (narrow / 2) ELSE 4 / 3.0::DOUBLE * pi() * (len / 2) * (wide / 2) * (wide / 2) END, 3) AS volume,
  round(len / wide, 6) AS aspect, round(len / wide - 1, 6) + 0 AS ellipticity,
  round(CASE WHEN len / wide > 1 THEN l_discount END, 6) + 0 AS curvature, round(log10(len), 6) AS log_len,
  round(sqrt(wide), 6) AS root_wide FROM m
""")
def derived_measures(spark, sf_dir):
    rows = _measured(spark, sf_dir)
    volume = measures.ellipsoid_volume(F.lit(None).cast("double"), "len", "wide", "narrow")
    aspect = measures.ratio("len", "wide")
    out = {"volume": (volume, 3), "aspect": (aspect, 6), "ellipticity": (measures.ellipticity("len", "wide"), 6), "curvature": (measures.void_unless("l_discount", aspect > 1), 6), "log_len": (log10("len"), 6), "root_wide": (measures.root("wide"), 6)}
    return rows.select("l_orderkey", "l_linenumber", *[F.round(v, n).alias(k) for k, (v, n) in out.items()])


@query(_RAW + """
SELECT count(*) AS n, count_if(len IS NULL) AS n_null, round(sum(len), 3) AS total FROM (
  SELECT * FROM (SELECT * FROM m WHERE len IS NULL OR len < (SELECT quantile_cont(len, 0.999) FROM m)) a
  WHERE wide IS NULL OR wide < (SELECT quantile_cont(wide, 0.999) FROM m WHERE len IS NULL OR len < (SELECT quantile_cont(len, 0.999) FROM m)))
""")
def two_quantile_trims(spark, sf_dir):
    rows = measures.trim_above(measures.trim_above(_measured(spark, sf_dir).select("len", "wide"), "len", 0.999), "wide", 0.999)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("len").isNull()).alias("n_null"), F.round(F.sum("len"), 3).alias("total"))


@query(_RAW + """
SELECT l_returnflag, count(*) AS n, round(avg(abs(xl - ml) / ((xl + ml) / 2)), 6) AS spread, round(avg(100 * (wide - narrow) / wide), 6) AS gap,
  round(avg(100 * (v2 - v3) / v2), 6) AS volume_gap FROM (
    SELECT *, 4 / 3.0::DOUBLE * pi() * (len / 2) * (wide / 2) * (wide / 2) AS v2, 4 / 3.0::DOUBLE * pi() * (len / 2) * (wide / 2) * (narrow / 2) AS v3 FROM m) GROUP BY 1
""")
def agreement(spark, sf_dir):
    gap, volume_gap = measures.shape_gap("w", "b", "len")
    rows = _measured(spark, sf_dir).withColumns({"s": measures.relative_spread("xl", "ml"), "g": gap, "v": F.when(F.col("b").isNotNull(), volume_gap)})
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("spread"), F.round(F.avg("g"), 6).alias("gap"), F.round(F.avg("v"), 6).alias("volume_gap"))


@query("""
WITH t AS (SELECT cast(round(p_retailprice, 1) AS DECIMAL(12, 1))::VARCHAR AS x FROM part), d AS (
  SELECT x, replace(x, '.', '') AS plain, x::DOUBLE AS v FROM t)
SELECT length(plain) - CASE WHEN v > 10 THEN 1 ELSE 0 END AS figures, ltrim(plain, '0')[1] AS first_digit, right(plain, 1) AS last_digit, count(*) AS n FROM d GROUP BY 1, 2, 3
""")
def digit_counts(spark, sf_dir):
    text = table(spark, sf_dir, "part").select(F.round("p_retailprice", 1).cast("decimal(12,1)").cast("string").alias("x"))
    d = measures.digits("x")
    return text.select(*[d[k].alias(k) for k in ("figures", "first_digit", "last_digit")]).groupBy("figures", "first_digit", "last_digit").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity / exp(-8000 * (1 / 293.15::DOUBLE - 1 / (l_extendedprice / 1000 + 250))), 6) AS normalised FROM lineitem
""")
def temperature_durations(spark, sf_dir):
    kelvin = F.col("l_extendedprice") / 1000 + 250
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(measures.temperature_normalised("l_quantity", kelvin), 6).alias("normalised"))


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '5-LOW')
""")
def without_problem_codes(spark, sf_dir):
    return measures.without_codes(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 60)")
def large_groups(spark, sf_dir):
    return measures.large_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


@query("SELECT p_type, count(*) AS n, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size IN (49, 50) THEN 'large' END AS label FROM part WHERE p_size IN (1, 2, 3, 49, 50) GROUP BY ALL")
def relabelled_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("s", F.col("p_size").cast("string"))
    label = measures.relabelled("s", {"small": ["1", "2", "3"], "large": ["49", "50"]})
    return rows.withColumn("label", label).where("label is not null").groupBy("p_type", "label").agg(F.count("*").alias("n"))


_RULES = [("region", "ASIA", "TRUE"), ("region", "EUROPE", "SOME"), ("nation", "NATION_2", "FALSE"), ("nation", "NATION_16", "TRUE"), ("segment", "BUILDING", "SOME"), ("nation", "NATION_16", "FALSE")]


def _places(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'derived' WHEN n_name = 'NATION_2' THEN 'ancestral' WHEN n_name = 'NATION_16' THEN 'ancestral'
  WHEN r_name IN ('ASIA', 'EUROPE') THEN 'derived' ELSE 'ancestral' END AS relaxed,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'ancestral' WHEN n_name = 'NATION_2' THEN 'ancestral' WHEN n_name = 'NATION_16' THEN 'ancestral'
  WHEN r_name = 'ASIA' THEN 'derived' ELSE 'ancestral' END AS strict
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def rank_cascade(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "rank string, name string, state string")
    ranks = ["region", "nation", "segment"]
    states = {"TRUE": "derived", "FALSE": "ancestral", "SOME": "derived"}
    rows = classify.cascade(_places(spark, sf_dir), rules, ranks, states, "ancestral", "relaxed")
    return classify.cascade(rows, rules, ranks, states | {"SOME": "ancestral"}, "ancestral", "strict").select("c_custkey", "relaxed", "strict")


@query("""
SELECT n_name, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'fine'
  WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA') THEN 'coarse' ELSE 'none' END AS level FROM nation
""")
def multi_level_flag(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    africa = table(spark, sf_dir, "region").where("r_name = 'AFRICA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return classify.finest_match(table(spark, sf_dir, "nation"), rich, africa, "n_nationkey", "n_regionkey", "level").select("n_name", "level")


@query("""
WITH p AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT 'region' AS rank, r_name AS taxon FROM p UNION ALL SELECT 'nation', n_name FROM p UNION ALL SELECT 'segment', c_mktsegment FROM p)
SELECT rank, taxon, count(*) AS n, any_value(total)::BIGINT AS total FROM c
LEFT JOIN (SELECT n_name AS name, count(*) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON rank = 'nation' AND taxon = name GROUP BY 1, 2
""")
def taxon_counts(spark, sf_dir):
    totals = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("taxon")).agg(F.count("*").alias("total")).withColumn("rank", F.lit("nation"))
    return classify.counts_by_rank(_places(spark, sf_dir), ["region", "nation", "segment"], totals)


@query("""
WITH again AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 AND max(o_totalprice) - min(o_totalprice) < 200000)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT * FROM again) UNION ALL
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders WHERE o_custkey IN (SELECT * FROM again)) WHERE r = 1
""")
def newest_of_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 2e11).alias("v"), "o_orderdate")
    return dedup.newest_of_repeats(rows, "o_custkey", "v", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5/' || o_orderkey)) AS r FROM orders) WHERE r = 1")
def one_random_each(spark, sf_dir):
    return dedup.random_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


@query("""
SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3/' || c_custkey)) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE r <= round(n * 0.25)
""")
def sampled_fraction(spark, sf_dir):
    return dedup.sample_fraction(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 0.25, 3)


@query("WITH s AS (SELECT max(l_tax) - min(l_tax) AS s FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) SELECT count_if(s < 1e-6) AS repeated, count_if(s > 1e-6) AS independent FROM s")
def repeat_split(spark, sf_dir):
    return dedup.repeat_split(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_tax")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS code FROM orders WHERE o_orderpriority IS NOT NULL")
def level_codes(spark, sf_dir):
    return dedup.level_codes(table(spark, sf_dir, "orders"), "o_orderpriority", "code").where("code is not null").select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_orderstatus) AS n_distinct FROM orders GROUP BY 1")
def distinct_per_group(spark, sf_dir):
    return stats.distinct_per(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query(_RAW + """
SELECT unnest(['long', 'no_breadth', 'cheap']) AS what, unnest([count_if(len > 40), count_if(b IS NULL), count_if(l_extendedprice < 1000)]) AS n FROM m
""")
def condition_report(spark, sf_dir):
    return stats.report(_measured(spark, sf_dir), {"long": F.col("len") > 40, "no_breadth": F.col("b").isNull(), "cheap": F.col("l_extendedprice") < 1000})


@query("SELECT p_brand, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1")
def grouped_means(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    out = stats.grouped_means(rows, "p_brand", ["p_size", "p_retailprice"])
    return out.select("p_brand", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("""
WITH v AS (SELECT l_returnflag, floor((log10(l_extendedprice) - 2.5) / 0.1)::INT AS bin FROM lineitem), g AS (
  SELECT l_returnflag, unnest(range(30))::INT AS bin FROM (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT l_returnflag, bin, count(v.bin) AS n FROM g LEFT JOIN v USING (l_returnflag, bin) GROUP BY 1, 2
""")
def log_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 2.5, 0.1, 30, ("l_returnflag",))


@query("""
SELECT l_returnflag, quantile_cont(l_quantity, 0) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS mid,
  quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_quantity, 1) AS high FROM lineitem GROUP BY 1
""")
def five_numbers(spark, sf_dir):
    return stats.five_numbers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT 'value' AS what, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM events")
def percentile_interval(spark, sf_dir):
    return stats.interval(table(spark, sf_dir, "events"), ["value"])


@query("""
WITH f AS (SELECT o_orderpriority AS grp, year(o_orderdate) % 3 AS tree, regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS intercept, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT grp, round(min(slope), 4) AS min_slope, round(max(slope), 4) AS max_slope, round(min(intercept), 4) AS min_intercept, round(max(intercept), 4) AS max_intercept, min(n) AS min_n FROM f GROUP BY 1
""")
def slope_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"tree": F.year("o_orderdate") % 3, "grp": F.col("o_orderpriority"), "x": F.col("o_custkey").cast("double")})
    return stats.envelope(regress.plain(rows, ["grp", "tree"], "x", "o_totalprice"), ["grp"], ["slope", "intercept"], "n")


@query("""
SELECT l_returnflag AS grp, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL SELECT 'ALL', round(regr_slope(l_extendedprice, l_quantity), 6), round(regr_intercept(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 6), count(*) FROM lineitem
""")
def plain_regressions(spark, sf_dir):
    rows = regress.with_whole(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp"), "grp")
    out = regress.plain(rows, ["grp"], "l_quantity", "l_extendedprice")
    return out.select("grp", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("""
WITH v AS (SELECT c_nationkey AS k, c_mktsegment AS model, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2),
w AS (SELECT k, max(v) FILTER (model = 'BUILDING') AS BUILDING, max(v) FILTER (model = 'MACHINERY') AS MACHINERY, max(v) FILTER (model = 'FURNITURE') AS FURNITURE FROM v GROUP BY 1),
s AS (SELECT *, list_sort([BUILDING, MACHINERY, FURNITURE]) AS l FROM w)
SELECT k, CASE WHEN l[2] - l[1] > 2 THEN CASE l[1] WHEN BUILDING THEN 'BUILDING' WHEN MACHINERY THEN 'MACHINERY' ELSE 'FURNITURE' END ELSE 'none' END AS choice, round(l[2] - l[1], 5) AS lead FROM s
WHERE BUILDING IS NOT NULL AND MACHINERY IS NOT NULL AND FURNITURE IS NOT NULL
""")
def model_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("model")).agg(F.avg("c_acctbal").alias("v"))
    models = ["BUILDING", "MACHINERY", "FURNITURE"]
    return stats.model_choice(rows, ["k"], "model", "v", models).dropna(subset=models).select("k", "choice", F.round("lead", 5).alias("lead"))


@query("""
WITH t AS (SELECT o_orderstatus AS s, min(o_totalprice) * 3 AS t FROM orders GROUP BY 1)
SELECT s, round(avg((o_totalprice > t)::INT::DOUBLE), 6) AS share FROM orders JOIN t ON s = o_orderstatus GROUP BY 1
""")
def tail_share(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    return stats.tail_share(rows, rows.withColumn("v", F.col("v") * 3), "s", "v").select("s", F.round("share", 6).alias("share"))


@query("SELECT o_orderpriority, what, round(value, 2) AS value FROM (SELECT o_orderpriority, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1) UNPIVOT (value FOR what IN (mean, most))")
def wide_to_long(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return stats.wide_to_long(rows, ["o_orderpriority"], ["mean", "most"]).withColumn("value", F.round("value", 2))


@query("SELECT c_custkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_name, c_custkey) AS new_id FROM customer")
def next_free_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return keys.numbered(rows, ["c_name", "c_custkey"], rows, "c_custkey", "new_id").select("c_custkey", "new_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1) AND (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
def repeated_tags(spark, sf_dir):
    return keys.repeated_tags(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


def _ladder_sql() -> str:
    """The rounds of ``keys.unique_references`` one after another."""
    steps = ["", *("".join(keys.LADDER[: k + 1]) for k in range(len(keys.LADDER)))]
    parts = ["used AS MATERIALIZED (SELECT 'ref' || c_custkey || 'a' AS u FROM customer)", "l0 AS MATERIALIZED (SELECT o_orderkey AS o, 'ref' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN 'ab' ELSE '' END AS id FROM orders)"]
    for k, step in enumerate(steps):
        taken = " UNION ALL ".join(["SELECT u FROM used", *(f"SELECT u FROM w{i}" for i in range(k))])
        parts.append(f"w{k} AS MATERIALIZED (SELECT id || '{step}' AS u, min(o) AS o FROM l{k} WHERE id || '{step}' NOT IN ({taken}) GROUP BY 1)")
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT o, id FROM l{k} WHERE o NOT IN (SELECT o FROM w{k}))")
    won = " UNION ALL ".join(f"SELECT o, u FROM w{k}" for k in range(len(steps)))
    return f"WITH {', '.join(parts)} SELECT o AS o_orderkey, u AS unique_id FROM ({won} UNION ALL SELECT o, NULL FROM l{len(steps)})"


@query(_ladder_sql())
def unique_references(spark, sf_dir):
    """All orders bring a reference id, some with a suffix of their own; the customers' ids with a suffix are in use."""
    tail = F.when(F.col("o_orderkey") % 5 == 0, "ab").otherwise("")
    new = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ref"), F.col("o_custkey").cast("string"), tail).alias("id"))
    used = table(spark, sf_dir, "customer").select(F.concat(F.lit("ref"), F.col("c_custkey").cast("string"), F.lit("a")).alias("id"))
    return keys.unique_references(new, used, "id", "o_orderkey").select("o_orderkey", "unique_id")


@query("""
SELECT doc_id, round(CASE WHEN n > 0 THEN length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g')) / n ELSE 0 END, 6) AS mean, n FROM (
  SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents)
""")
def word_stats(spark, sf_dir):
    mean, n = textmine.word_stats("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(mean, 6).alias("mean"), n.cast("long").alias("n"))


_FREQ = r"""
WITH w AS (SELECT lower(regexp_replace(unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), f AS (SELECT word, n / (SELECT sum(n) FROM c) AS freq FROM c WHERE n > 1)
"""


@query(_FREQ + "SELECT word, round(freq, 12) AS freq FROM f")
def word_frequencies(spark, sf_dir):
    return textmine.corpus_frequencies(table(spark, sf_dir, "documents"), "text").select("word", F.round("freq", 12).alias("freq"))


_TERMS = _FREQ + r""", d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS word FROM documents),
t AS (SELECT doc_id, count(*) AS total FROM d GROUP BY 1),
g AS (SELECT doc_id, lower(word) AS word, count(*) AS n FROM d WHERE regexp_full_match(word, '[a-z][A-Za-z]{4,}') AND regexp_matches(lower(word), '[aeimnorsx]$') GROUP BY ALL HAVING count(*) > 5),
r AS (SELECT doc_id, word, n, coalesce(n::DOUBLE / total / freq, 100000) AS rel FROM g JOIN t USING (doc_id) LEFT JOIN f USING (word))
"""


@query(_TERMS + r"""SELECT doc_id, word, n, round(rel, 4) AS rel, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, n DESC, word) AS place FROM r) WHERE place <= 5
""")
def distinctive_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = textmine.distinctive_terms(docs, "doc_id", "text", textmine.corpus_frequencies(docs, "text"))
    return out.select("doc_id", "word", "n", F.round("rel", 4).alias("rel"), F.col("place").cast("long").alias("place"))


@query(_TERMS + r""", p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, n DESC, word) AS place FROM r),
v AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
i AS (SELECT doc_id, word, place, ws, list_position(ws, word) AS i FROM p JOIN v USING (doc_id) WHERE place <= 5),
b AS (SELECT *, CASE WHEN i > 1 THEN ws[i - 1] WHEN i = 1 THEN ws[len(ws)] END AS before FROM i),
n AS (SELECT *, coalesce(length(before) > 3 AND regexp_matches(before, '^[A-Z]'), false) AS named FROM b)
SELECT doc_id, coalesce(arg_min(before, place) FILTER (named), '') AS first, coalesce(arg_min(word, place) FILTER (named), arg_min(word, place)) AS second FROM n GROUP BY 1
""")
def preceding_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return textmine.preceding_name(docs, "doc_id", "text", textmine.distinctive_terms(docs, "doc_id", "text", textmine.corpus_frequencies(docs, "text")))


_SCORE = " + ".join(f"CASE WHEN {' OR '.join(f'contains(s, $${t}$$)' for t in terms)} THEN {w} ELSE 0 END" for terms, w in textmine.TERMS)


@query(f"""
WITH k AS (SELECT doc_id, text, unnest(range(greatest(length(text) // 20, 1))) * 20 AS start FROM documents WHERE length(text) >= 400),
s AS (SELECT doc_id, start, substr(text, start + 1, 400) AS s FROM k), c AS (
  SELECT doc_id, start, {_SCORE} + CASE WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) > 3 THEN 2 ELSE 0 END AS score FROM s)
SELECT doc_id, arg_max(start, score * 1000000000 - start) AS start, max(score)::BIGINT AS score FROM c WHERE score > 0 GROUP BY 1
""")
def best_windows(spark, sf_dir):
    out = textmine.best_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("score").cast("long").alias("score"))


@query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x20-\x7E\t\n\x0B\f\r]', '?', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') AS text FROM documents),
k AS (SELECT doc_id, text, unnest(range(greatest(length(text) // 20, 1))) * 20 AS start FROM d WHERE length(text) >= 400),
s AS (SELECT doc_id, start, substr(text, start + 1, 400) AS s FROM k), c AS (
  SELECT doc_id, start, s, {_SCORE} + CASE WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) > 3 THEN 2 ELSE 0 END AS score FROM s),
b AS (SELECT doc_id, arg_max(start, score * 1000000000 - start) AS start, max(score) AS score, arg_max(s, score * 1000000000 - start) AS p FROM c WHERE score > 0 GROUP BY 1),
a AS (SELECT *, coalesce(nullif(instr(p, 'mm'), 0), nullif(instr(p, 'length'), 0), nullif(instr(p, 'egg'), 0), nullif(instr(p, 'the'), 0)) AS pos FROM b),
h AS (SELECT *, substr(p, 1, pos - 1) AS l, substr(p, pos + 1) AS r FROM a),
f AS (SELECT *, CASE WHEN regexp_matches(l, '[0-9]') THEN length(regexp_extract(l, '(?s)[0-9]([^0-9]*)$', 1)) END AS fl, CASE WHEN regexp_matches(r, '[0-9]') THEN length(regexp_extract(r, '(?s)^([^0-9]*)[0-9]', 1)) END AS fr FROM h),
n AS (SELECT *, CASE WHEN fl IS NULL AND fr IS NULL THEN NULL WHEN fl IS NOT NULL AND (fr IS NULL OR fl <= fr) THEN regexp_extract(l, '(?s)([^A-Za-z]*[0-9])[^0-9]*$', 1) ELSE regexp_extract(r, '(?s)^[^0-9]*([0-9][^A-Za-z]*)', 1) END AS x FROM f)
SELECT doc_id, start::INTEGER AS start, score::INTEGER AS score, pos::INTEGER AS "at", regexp_replace(x, '^[\s!-/:-@\[-`{{-~]+|[\s!-/:-@\[-`{{-~]+$', '', 'g') AS number FROM n
""")
def mined_documents(spark, sf_dir):
    return textmine.mined(table(spark, sf_dir, "documents"), "doc_id", "text", ["mm", "length", "egg", "the"])


def _entries(spark, sf_dir):
    """Records of parts with faults by key."""
    k = F.col("p_partkey")
    pairs = {"ID": k.cast("string"), "b": F.when(k % 11 != 0, "r"), "g": F.when(k % 13 != 0, F.concat(F.lit(" "), F.col("p_brand"))), "al": F.col("p_size").cast("string"), "dl": F.when(k % 3 == 0, F.when(k % 6 == 0, "99").otherwise("0.5")), "odd": F.when(k % 17 == 0, "7"), "xw": F.when(k % 5 == 0, "x1")}
    filled = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs.items()])), lambda n, v: v.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("entry"))


@query("""
WITH e AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, CASE WHEN k % 5 = 0 OR k % 3 <> 0 OR k % 11 = 0 OR k % 13 = 0 THEN 'rnsd' WHEN k % 17 = 0 THEN 'comp' WHEN s > 30 OR k % 6 = 0 OR (0.5 >= s) THEN 'cols' ELSE 'sqky' END AS status,
  k % 17 = 0 AND (k % 3 <> 0) <> (k % 5 = 0) AS repairable FROM e
""")
def record_status(spark, sf_dir):
    rows = clean.checked(_entries(spark, sf_dir), "entry")
    return rows.select("p_partkey", "status", clean.suggestion("entry").isNotNull().alias("repairable"))


def _edges(spark, sf_dir, lengths: bool = True):
    """region > nation > customer > order as one tree per region; lengths from numeric columns."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("tree_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), (F.col("n_nationkey") + 1.0).alias("length"), "n_nationkey")
    cust = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("tree_id", F.col("child").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), (F.col("c_custkey") % 7 + 1.0).alias("length"), "c_custkey")
    order = table(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("tree_id", F.col("child").alias("parent"), F.concat(F.lit("o"), "o_orderkey").alias("child"), (F.col("o_orderkey") % 5 + 1.0).alias("length"))
    return nation.drop("n_nationkey").unionByName(cust.drop("c_custkey")).unionByName(order)


_CUST = "SELECT n_regionkey, n_nationkey, c_custkey, count(o_orderkey) AS orders, greatest(count(o_orderkey), 1) AS tips FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3"


@query(f"""
WITH c AS ({_CUST}) SELECT n_regionkey::VARCHAR AS tree_id, 'c' || c_custkey AS node, tips FROM c UNION ALL
SELECT n_regionkey::VARCHAR, 'n' || n_nationkey, sum(tips)::BIGINT FROM c GROUP BY ALL UNION ALL
SELECT n_regionkey::VARCHAR, 'r' || n_regionkey, sum(tips)::BIGINT FROM c GROUP BY ALL UNION ALL
SELECT n_regionkey::VARCHAR, 'o' || o_orderkey, 1 FROM c JOIN orders ON o_custkey = c_custkey
""")
def tips_below(spark, sf_dir):
    return hierarchy.tip_counts(_edges(spark, sf_dir))


@query(f"""
WITH c AS ({_CUST}), n AS (SELECT n_nationkey, sum(tips) AS t FROM c GROUP BY 1), r AS (SELECT n_regionkey, sum(tips) AS t FROM c GROUP BY 1)
SELECT CASE WHEN r.t <= 20 THEN 'r' || n_regionkey WHEN n.t <= 20 THEN 'n' || n_nationkey WHEN c.tips <= 20 THEN 'c' || c_custkey END AS clade, sum(tips)::BIGINT AS n
FROM c JOIN n USING (n_nationkey) JOIN r USING (n_regionkey) WHERE c.tips <= 20 GROUP BY 1
UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders JOIN c ON o_custkey = c_custkey WHERE c.tips > 20
""")
def clades_of_tips(spark, sf_dir):
    return hierarchy.clades(_edges(spark, sf_dir), 20).groupBy("clade").agg(F.count("*").alias("n"))


@query(f"""
WITH c AS ({_CUST}), n AS (SELECT n_nationkey, sum(tips) AS t FROM c GROUP BY 1), r AS (SELECT n_regionkey, sum(tips) AS t FROM c GROUP BY 1),
p AS (SELECT n_regionkey AS tree, coalesce('o' || o_orderkey, 'c' || c_custkey) AS tip, o_orderstatus AS ord, floor(o_totalprice / 7)::BIGINT::VARCHAR AS family,
  CASE WHEN r.t <= 20 THEN 'r' || n_regionkey WHEN n.t <= 20 THEN 'n' || n_nationkey WHEN c.tips <= 20 THEN 'c' || c_custkey ELSE 'o' || o_orderkey END AS clade
  FROM c JOIN n USING (n_nationkey) JOIN r USING (n_regionkey) LEFT JOIN orders ON o_custkey = c_custkey),
s AS (SELECT clade, count(*) AS n, min(tip) AS tip FROM p GROUP BY 1 HAVING count(*) > 10),
f AS (SELECT family, min(clade) AS clade FROM p WHERE family IS NOT NULL GROUP BY tree, family HAVING min(clade) = max(clade))
SELECT s.clade, s.n, s.tip, concat_ws('_', s.clade, p.ord) AS label, f.family FROM s JOIN p USING (tip) LEFT JOIN f ON f.clade = s.clade
""")
def large_clades(spark, sf_dir):
    """Maximal clades of 11 to 20 tips, each with its first tip, and a row for every family that only it holds."""
    parts = cut(hierarchy.clades(_edges(spark, sf_dir), 20), "clades")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.floor(F.col("o_totalprice") / 7).cast("string").alias("family"), F.col("o_orderstatus").alias("order1"))
    tips = hierarchy.representatives(parts, orders)
    large = hierarchy.large_clades(parts, 10).join(tips, ["tree_id", "clade"])
    return large.join(hierarchy.own_families(parts, orders), ["tree_id", "clade"], "left").select("clade", "n", "tip", "label", "family")


_STATE = "CASE WHEN {} % 3 = 0 THEN 1 ELSE 0 END"


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, {_STATE.format("o_orderkey")} AS s, {_STATE.format("o_custkey")} AS p FROM orders),
k AS (SELECT c_custkey, {_STATE.format("c_custkey")} AS s, {_STATE.format("c_nationkey")} AS p FROM customer),
n AS (SELECT n_nationkey, {_STATE.format("n_nationkey")} AS s FROM nation)
SELECT 'o' || o_orderkey AS node, s - p AS change, 1::BIGINT AS tips, 0::BIGINT AS nodes FROM o WHERE s <> p UNION ALL
SELECT 'c' || c_custkey, s - p, greatest(count(o_orderkey), 1), 0 FROM k LEFT JOIN orders ON o_custkey = c_custkey WHERE s <> p GROUP BY ALL UNION ALL
SELECT 'n' || n_nationkey, s, sum(tips)::BIGINT, count(*) FILTER (orders > 0) FROM n JOIN ({_CUST}) USING (n_nationkey) WHERE s = 1 GROUP BY ALL
""")
def gains_and_reversals(spark, sf_dir):
    """Edges of the places' tree along which a state made from keys appears or goes, with what lies below."""
    edges = _edges(spark, sf_dir)
    return hierarchy.state_changes(edges, _states(edges)).select("node", "change", "tips", "nodes")


def _states(edges):
    nodes = edges.select("tree_id", F.col("child").alias("node")).unionByName(edges.select("tree_id", F.col("parent").alias("node"))).distinct()
    number = F.regexp_extract("node", "[0-9]+", 0).cast("long")
    return nodes.withColumn("state", F.when(F.col("node").startswith("r"), 0).otherwise(F.when(number % 3 == 0, 1).otherwise(0)))


_PLACED = f"""
WITH t AS (SELECT coalesce('o' || o_orderkey, 'c' || c_custkey) AS tip, 'o' || o_orderkey AS o, 'c' || c_custkey AS c, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r,
    {_STATE.format("o_orderkey")} AS so, {_STATE.format("c_custkey")} AS sc, {_STATE.format("n_nationkey")} AS sn
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
"""


@query(_PLACED + """
SELECT o AS node, so - sc AS change, tip FROM t WHERE o IS NOT NULL AND so <> sc UNION ALL
SELECT c, sc - sn, tip FROM t WHERE sc <> sn UNION ALL SELECT n, sn, tip FROM t WHERE sn = 1
""")
def tips_of_gains(spark, sf_dir):
    """A row for every tip below each gain or reversal of the state."""
    edges = _edges(spark, sf_dir)
    return hierarchy.tips_of_changes(edges, _states(edges)).select("node", "change", "tip")


@query(_PLACED + """
, k AS (SELECT DISTINCT r, n, c, sc, sn FROM t), m AS (SELECT DISTINCT r, n, sn FROM t)
SELECT o AS node, CASE WHEN so <> sc THEN o WHEN sc <> sn THEN c WHEN sn = 1 THEN n END AS shift FROM t WHERE o IS NOT NULL UNION ALL
SELECT c, CASE WHEN sc <> sn THEN c WHEN sn = 1 THEN n END FROM k UNION ALL SELECT n, CASE WHEN sn = 1 THEN n END FROM m UNION ALL SELECT DISTINCT r, NULL FROM m
""")
def nearest_shifts(spark, sf_dir):
    """Every node with the nearest change of state at or above it."""
    edges = _edges(spark, sf_dir)
    return hierarchy.shifts(edges, _states(edges)).select("node", "shift")


@query("""
WITH RECURSIVE k AS (SELECT o_orderkey, c_custkey, c_nationkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 450000),
e AS (SELECT 'c' || c_custkey AS parent, 'o' || o_orderkey AS child, o_orderkey % 5 + 1.0::DOUBLE AS v FROM k UNION
  SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey % 7 + 1.0::DOUBLE FROM k UNION SELECT 'r' || n_regionkey, 'n' || c_nationkey, c_nationkey + 1.0::DOUBLE FROM k),
one AS (SELECT parent FROM e GROUP BY 1 HAVING count(*) = 1),
up AS (SELECT child, parent, v FROM e WHERE child NOT IN (SELECT * FROM one) UNION ALL
  SELECT up.child, e.parent, up.v + e.v FROM up JOIN e ON e.child = up.parent WHERE up.parent IN (SELECT * FROM one))
SELECT child, parent, v AS length FROM up WHERE parent NOT IN (SELECT * FROM one)
""")
def contracted_tree(spark, sf_dir):
    """The places' tree pruned to the dearest orders, its single-child chains merged."""
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    edges = _edges(spark, sf_dir)
    keep = dear.join(edges.select("tree_id", F.col("child").alias("node")), "node")
    return hierarchy.contracted(hierarchy.pruned(edges, keep)).select("child", "parent", "length")


def _tips(spark, sf_dir):
    x = table(spark, sf_dir, "orders")
    edges = _edges(spark, sf_dir)
    return x.join(edges.select("tree_id", "child"), F.concat(F.lit("o"), F.col("o_orderkey")) == F.col("child")).select("tree_id", F.lit("price").alias("fit"), F.col("child").alias("node"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))


def _level(src: str, up: str, own: str, keep: str) -> str:
    return f"""
  m AS (SELECT {up}, sum(1 / v) AS w, sum(x / v) / sum(1 / v) AS mx, sum(y / v) / sum(1 / v) AS my FROM {src} GROUP BY ALL),
  t AS (SELECT {up}, w, mx AS x, my AS y, sum(sxx + (x - mx) ** 2 / v) AS sxx, sum(sxy + (x - mx) * (y - my) / v) AS sxy, sum(n) AS n FROM {src} JOIN m USING ({keep}) GROUP BY ALL)
  SELECT * EXCLUDE (w), {own} + 1 / w AS v FROM t"""


@query(f"""
WITH o AS (SELECT n_regionkey AS r, n_nationkey AS k, c_custkey AS c, o_orderkey % 5 + 1.0::DOUBLE AS v, (o_orderkey % 97)::DOUBLE AS x, o_totalprice / 1000 AS y, 0.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 1 AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (WITH {_level("o", "r, k, c", "c % 7 + 1.0::DOUBLE", "r, k, c").strip()}),
k AS (WITH {_level("c", "r, k", "k + 1.0::DOUBLE", "r, k").strip()}),
g AS (WITH {_level("k", "r", "0.0::DOUBLE", "r").strip()})
SELECT r::VARCHAR AS tree_id, round(sxy / sxx, 6) AS slope, round(y - sxy / sxx * x, 4) AS intercept, n::BIGINT AS n FROM g
""")
def tree_regressions(spark, sf_dir):
    fits = treefold.fold(_edges(spark, sf_dir), _tips(spark, sf_dir))
    return fits.select("tree_id", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


def _sweep_sql() -> str:
    """Nested sums over region > nation > customer, for fits on the traits and, before, for those on the third trait."""
    def fold(name: str, src: str, keys: str) -> str:
        return f"""
{name}1 AS (WITH {_level(src, f"{keys}, r, k", "k % 5 + 1 + t * 0.5::DOUBLE", f"{keys}, r, k").strip()}),
{name}2 AS (WITH {_level(f"{name}1", f"{keys}, r", "r + 1.0::DOUBLE + t", f"{keys}, r").strip()}),
{name}3 AS (WITH {_level(f"{name}2", keys, "0.0::DOUBLE", keys).strip()})"""

    zero = "0.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 1 AS n"
    return f"""
WITH b AS (
  SELECT t, n_regionkey AS r, n_nationkey AS k, c_custkey AS c, c_custkey % 7 + 1 + t % 2 + 0.0::DOUBLE AS v, unnest(['ALL', c_mktsegment]) AS grp, (c_custkey % 97)::DOUBLE AS p,
    CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 1000 END AS q, (c_custkey % 31)::DOUBLE AS z FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest(range(5)) AS t)),
g AS (SELECT t, grp, r, k, c, v, p, q, z FROM b WHERE q IS NOT NULL),
ox AS (SELECT t, grp, r, k, c, v, z AS x, p AS y, {zero} FROM g), oy AS (SELECT t, grp, r, k, c, v, z AS x, q AS y, {zero} FROM g), {fold("ax", "ox", "t, grp")}, {fold("ay", "oy", "t, grp")},
s AS (SELECT t, grp, ax3.sxy / ax3.sxx AS slope_x, ax3.y - ax3.sxy / ax3.sxx * ax3.x AS ix, ay3.sxy / ay3.sxx AS slope_y, ay3.y - ay3.sxy / ay3.sxx * ay3.x AS iy FROM ax3 JOIN ay3 USING (t, grp)),
o AS (SELECT 'parts' AS cmp, t, grp, r, k, c, v, z AS x, p AS y, {zero} FROM b UNION ALL SELECT 'balance', t, grp, r, k, c, v, p, q, {zero} FROM g UNION ALL
  SELECT 'given', t, grp, r, k, c, v, p - ix - slope_x * z, q - iy - slope_y * z, {zero} FROM g JOIN s USING (t, grp)), {fold("f", "o", "cmp, t, grp")}
SELECT t::VARCHAR AS tree_id, cmp AS comparison, grp AS "group", round(sxy / sxx, 6) + 0 AS slope, round(y - sxy / sxx * x, 4) + 0 AS intercept, n::BIGINT AS n FROM f3
"""


def _place_trees(spark, sf_dir):
    """Five trees over the same customers, whose lengths differ by tree."""
    nation, customer, t = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), F.col("t")
    of = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    region = nation.select(F.lit("root").alias("parent"), of("r", "n_regionkey").alias("child"), F.col("n_regionkey").alias("i"), F.lit(0).alias("kind")).distinct()
    below = nation.select(of("r", "n_regionkey").alias("parent"), of("n", "n_nationkey").alias("child"), F.col("n_nationkey").alias("i"), F.lit(1).alias("kind"))
    tips = customer.select(of("n", "c_nationkey").alias("parent"), of("c", "c_custkey").alias("child"), F.col("c_custkey").alias("i"), F.lit(2).alias("kind"))
    every = region.unionByName(below).unionByName(tips).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4))))
    length = F.when(F.col("kind") == 0, F.col("i") + 1 + t).when(F.col("kind") == 1, F.col("i") % 5 + 1 + t * 0.5).otherwise(F.col("i") % 7 + 1 + t % 2)
    return every.select(t.cast("string").alias("tree_id"), "parent", "child", length.cast("double").alias("length"))


@query(_sweep_sql())
def tree_sweep(spark, sf_dir):
    """Three comparisons, one of them given a third trait, for all customers and each segment along five trees."""
    k = F.col("c_custkey")
    traits = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("node"), F.col("c_mktsegment").alias("segment"), (k % 97).alias("p"), F.when(k % 11 != 0, F.col("c_acctbal") / 1000).alias("q"), (k % 31).alias("z"))
    out = regress.sweep(_place_trees(spark, sf_dir), traits, [("parts", "z", "p", None), ("balance", "p", "q", None), ("given", "p", "q", "z")], "segment")
    return out.select("tree_id", "comparison", "group", (F.round("slope", 6) + 0).alias("slope"), (F.round("intercept", 4) + 0).alias("intercept"), F.col("n").cast("long").alias("n"))


@query()
def tree_regression_tests(spark, sf_dir):
    return regress.along_tree(_edges(spark, sf_dir), _tips(spark, sf_dir))


@query("""
SELECT o_orderkey, finite_price FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS finite_price FROM orders) WHERE finite_price IS NOT NULL
""")
def complete_rows(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 9 == 0, F.when(F.col("o_orderkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("o_totalprice"))
    return measures.complete(table(spark, sf_dir, "orders").select("o_orderkey", finite(price).alias("finite_price")), ["finite_price"])


@query(f"""
WITH d AS (SELECT n_regionkey AS r, n_nationkey AS k, c_custkey AS c, n_nationkey + 1.0::DOUBLE AS dk, n_nationkey + 1.0::DOUBLE + c_custkey % 7 + 1 AS dc, o_orderkey, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT r, k, c, (dc + o_orderkey % 5 + 1) ** (1 / 1.3::DOUBLE) - dc ** (1 / 1.3::DOUBLE) AS v, dc, dk, (o_orderkey % 97)::DOUBLE AS x, o_totalprice / 1000 AS y, 0.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 1 AS n FROM d),
c AS (WITH {_level("o", "r, k, c, dc, dk", "dc ** (1 / 1.3::DOUBLE) - dk ** (1 / 1.3::DOUBLE)", "r, k, c, dc, dk").strip()}),
k AS (WITH {_level("c", "r, k, dk", "dk ** (1 / 1.3::DOUBLE)", "r, k, dk").strip()}),
g AS (WITH {_level("k", "r", "0.0::DOUBLE", "r").strip()})
SELECT r::VARCHAR AS tree_id, round(sxy / sxx, 6) AS slope, round(y - sxy / sxx * x, 4) AS intercept, n::BIGINT AS n FROM g
""")
def accelerated_regressions(spark, sf_dir):
    fits = treefold.fold(treemodels.accelerated(_edges(spark, sf_dir)), _tips(spark, sf_dir))
    return fits.select("tree_id", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query()
def tree_models(spark, sf_dir):
    traits = _tips(spark, sf_dir).select("tree_id", F.col("fit").alias("trait"), "node", "y")
    return treemodels.best_models(treemodels.model_fits(_edges(spark, sf_dir), traits, {"lambda": [0.25, 0.5, 0.75], "early": [-0.1, 0.1], "pull": [0.1, 0.5]}))


@query()
def vector_hulls(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    return hulls.convex_hulls(e, ["label"], "a", "b")


@query("""
WITH p AS (SELECT p_brand AS grp, p_partkey AS k, p_type, p_name FROM part),
a AS (SELECT grp, count(*)::BIGINT AS refs FROM p GROUP BY 1),
b AS (SELECT grp, count(*) AS examined, count(*) FILTER (k % 4 = 0) AS no_access, count(*) FILTER (k % 4 = 1) AS kept FROM p WHERE k % 3 <> 0 AND grp NOT LIKE '%2' GROUP BY 1),
c AS (SELECT grp, count(*) AS entries, count(DISTINCT p_type) AS genera, count(DISTINCT p_type || p_name) AS species FROM p WHERE k % 2 = 0 AND grp NOT LIKE '%1' GROUP BY 1),
w AS (SELECT grp, refs, examined, no_access, kept, examined - no_access - kept AS good, entries, genera, species FROM a LEFT JOIN b USING (grp) LEFT JOIN c USING (grp)),
t AS (SELECT * FROM w UNION ALL SELECT 'total', sum(refs), sum(examined), sum(no_access), sum(kept), sum(good), sum(entries), sum(genera), sum(species) FROM w)
SELECT grp, coalesce(refs::BIGINT::VARCHAR, '-') AS refs, coalesce(examined::BIGINT::VARCHAR, '-') AS examined, coalesce(no_access::BIGINT::VARCHAR, '-') AS no_access, coalesce(kept::BIGINT::VARCHAR, '-') AS kept,
  coalesce(good::BIGINT::VARCHAR, '-') AS good, coalesce(entries::BIGINT::VARCHAR, '-') AS entries, coalesce(genera::BIGINT::VARCHAR, '-') AS genera, coalesce(species::BIGINT::VARCHAR, '-') AS species FROM t
""")
def progress_report(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "grp")
    examined = p.where((k % 3 != 0) & ~F.col("grp").endswith("2")).withColumn("mark", F.when(k % 4 == 0, "x #NO").when(k % 4 == 1, "#KP"))
    return reports.progress(p, examined, p.where((k % 2 == 0) & ~F.col("grp").endswith("1")), "grp", "mark", "p_type", "p_name")


@query("SELECT 'p_brand' AS what, count(DISTINCT coalesce(p_brand, ''))::BIGINT AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT coalesce(p_type, ''))::BIGINT FROM part")
def distinct_sources(spark, sf_dir):
    return reports.distinct_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("""
WITH a AS (SELECT o_orderpriority, median(o_totalprice) AS mid, count(*)::BIGINT AS n FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority, median(o_totalprice) AS mid, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderpriority, a.mid AS whole_mid, a.n AS whole_n, b.mid AS done_mid, b.n AS done_n FROM a LEFT JOIN b USING (o_orderpriority)
""")
def results_side_by_side(spark, sf_dir):
    each = lambda t: stats.medians(t, ["o_orderpriority"], "o_totalprice", "mid")
    orders = table(spark, sf_dir, "orders")
    return reports.side_by_side(each(orders), each(orders.where("o_orderstatus = 'F'")), ["o_orderpriority"], ["mid", "n"], ("whole", "done"))


@query("""
WITH s AS (SELECT o_custkey, max(CASE WHEN o_totalprice > 200000 THEN 2 ELSE 1 END) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS custkey, (CASE WHEN c_acctbal < 0 THEN 2 WHEN s = 2 THEN 3 ELSE 1 END)::INTEGER AS state FROM customer LEFT JOIN s ON o_custkey = c_custkey
""")
def three_state_overlay(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.when(F.col("c_acctbal") < 0, 2).otherwise(1).alias("state"))
    second = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.when(F.col("o_totalprice") > 200000, 2).otherwise(1).alias("state"))
    return reports.three_states(first, second, "custkey", "state")


@query("""
SELECT n_name AS label, n_nationkey, s.n FROM nation FULL JOIN (SELECT s_nationkey, count(*)::BIGINT AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey
""")
def nodes_and_tips(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), "n_nationkey")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("label").agg(F.count("*").alias("n"))
    return reports.nodes_with_tips(nation, rich, "label")


@query("""
WITH g AS (SELECT p_brand, min((p_size, p_type)) AS g FROM part GROUP BY 1)
SELECT p_partkey, p_brand, g[1] AS least_size, g[2] AS least_type FROM part JOIN g USING (p_brand)
""")
def named_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return reports.with_groups(part.select("p_partkey", "p_brand"), part.select("p_brand", F.col("p_size").alias("least_size"), F.col("p_type").alias("least_type")), "p_brand")


@query("""
WITH a AS (SELECT c_mktsegment AS name, arg_min(c_acctbal, md5('4/' || c_custkey)) AS v FROM customer WHERE c_acctbal IS NOT NULL AND coalesce(c_mktsegment, '') <> '' GROUP BY 1),
b AS (SELECT CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 6 = 1 THEN 'MACHINERY' WHEN s_suppkey % 6 = 2 THEN 'BUILDING' ELSE 'other' END AS name, arg_min(s_acctbal, md5('4/' || s_suppkey)) AS w
  FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1)
SELECT name, v, w FROM a JOIN b USING (name)
""")
def paired_sets(spark, sf_dir):
    """Two data sets restricted to shared keys, one drawn row each."""
    k = F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("v"))
    name = F.when(k % 6 == 0, "").when(k % 6 == 1, "MACHINERY").when(k % 6 == 2, "BUILDING").otherwise("other")
    b = table(spark, sf_dir, "supplier").select(k.alias("id"), name.alias("name"), F.when(k % 7 != 0, F.col("s_acctbal")).alias("w"))
    return classify.paired(a, b, "name", "id", ["v"], ["w"], 4)


@query("""
SELECT l_orderkey, l_linenumber, round(10 * l_quantity, 6) AS length_mm, round(l_tax + 1, 6) AS aspect, round(10 * l_quantity / (l_tax + 1), 6) AS width_mm,
  round(0.5::DOUBLE ** (-l_discount / (2 + l_discount)) * 1.5::DOUBLE ** (l_discount / (2 + l_discount)) - 1, 9) + 0 AS asymmetry,
  round(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / l_extendedprice ELSE l_tax / 7 END, 9) AS image_aspect
FROM lineitem
""")
def other_data_set(spark, sf_dir):
    """Another data set's parameters in our units, and the aspect ratio with pixels where millimetres are missing."""
    got = measures.converted("l_quantity", "l_tax", "l_discount")
    image = measures.image_aspect(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")), "l_extendedprice", "l_tax", F.lit(7.0))
    r = lambda k, places: F.round(got[k], places).alias(k)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r("length_mm", 6), r("aspect", 6), r("width_mm", 6), r("asymmetry", 9), F.round(image, 9).alias("image_aspect"))


@query("""
WITH t AS (SELECT p_partkey, cast(round(p_retailprice, 1) AS DECIMAL(12, 1))::VARCHAR AS x FROM part), d AS (SELECT *, x::DOUBLE AS v, length(replace(x, '.', '')) - CASE WHEN x::DOUBLE > 10 THEN 1 ELSE 0 END AS f FROM t)
SELECT p_partkey, round(u, 9) AS unit, round(u / v, 12) AS precision FROM (SELECT *, 10.0::DOUBLE ** (1 - f) * CASE WHEN v > 10 THEN 0.1::DOUBLE ELSE 1 END AS u FROM d)
""")
def digit_precision(spark, sf_dir):
    text = table(spark, sf_dir, "part").select("p_partkey", F.round("p_retailprice", 1).cast("decimal(12,1)").cast("string").alias("x"))
    d = measures.digits("x")
    return text.select("p_partkey", F.round(d["unit"], 9).alias("unit"), F.round(d["precision"], 12).alias("precision"))


@query("""
SELECT o_orderkey, CASE WHEN s1 IS NULL THEN w WHEN s2 IS NULL OR s3 IS NULL THEN NULL ELSE greatest(s1, s2, s3) END AS widest, round(low, 6) AS log_low, round(mean_log, 6) AS mean_log, first_known,
  diff, round(share, 9) AS share
FROM (SELECT o_orderkey, o_totalprice AS w, CASE WHEN k % 2 = 0 THEN p END AS s1, CASE WHEN k % 3 <> 0 THEN p + 1 END AS s2, p - 1 AS s3,
  log10(k + 1.0::DOUBLE) AS low, (log10(k + 1.0::DOUBLE) + log10(o_custkey + 1.0::DOUBLE)) / 2 AS mean_log, CASE WHEN k % 5 = 0 THEN -1.0 ELSE p END AS first_known,
  p - (k + 1) AS diff, (p - (k + 1)) / (k + 1) AS share FROM (SELECT *, o_orderkey AS k, floor(o_totalprice) AS p FROM orders))
""")
def body_and_section_measures(spark, sf_dir):
    """The widest of three sections, body measures, the first of two sources, and errors of a repeat measurement."""
    k, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    rows = table(spark, sf_dir, "orders").withColumns({"p": p, "low": k + 1.0, "high": F.col("o_custkey") + 1.0})
    s1, s2 = F.when(k % 2 == 0, F.col("p")), F.when(k % 3 != 0, F.col("p") + 1)
    body = measures.body_measures("low", "high")
    first = measures.first_source(F.when(k % 5 == 0, F.lit(-1.0)).otherwise(F.lit(float("nan"))), "p")
    diff, share = measures.error_of("p", "low")
    return rows.select("o_orderkey", measures.widest("o_totalprice", s1, s2, F.col("p") - 1).alias("widest"), F.round(body["log_low"], 6).alias("log_low"), F.round(body["mean_log"], 6).alias("mean_log"), first.alias("first_known"), diff.alias("diff"), F.round(share, 9).alias("share"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace('(' || p_name || ').', '^\\W+', ''), '\\W+$', '') AS bare, split_part(p_name, ' ', 1) AS head,
  CASE WHEN p_partkey % 2 = 0 THEN (p_size || '.5')::DOUBLE ELSE p_size::DOUBLE END AS point, replace(p_name, ' ', '  ') AS spaced FROM part
""")
def text_fields(spark, sf_dir):
    """Names without marks at their ends, first words, decimal commas, and white space put in and thinned again."""
    part = table(spark, sf_dir, "part")
    head, _ = textmine.name_parts(F.concat(F.col("p_name"), F.lit(" x")))
    comma = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",0")))
    spaced = textmine.thinned(F.regexp_replace(textmine.collapsed("p_name"), " ", "   "))
    return part.select("p_partkey", clean.bare_name(F.concat(F.lit("("), F.col("p_name"), F.lit(")."))).alias("bare"), head.alias("head"), textmine.decimal_point(comma).alias("point"), spaced.alias("spaced"))


_WINS = """
WITH v AS (SELECT o_orderstatus AS trait, o_custkey % 20 AS rep, lower(substr(o_orderpriority, 3)) AS model, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
w AS (SELECT trait, rep, max(v) FILTER (model = 'urgent') AS u, max(v) FILTER (model = 'high') AS h, max(v) FILTER (model = 'medium') AS m FROM v GROUP BY ALL),
l AS (SELECT trait, unnest(['urgent', 'high', 'medium']) AS model, unnest([u, h, m]) AS v, list_sort([u, h, m]) AS l FROM w WHERE u IS NOT NULL AND h IS NOT NULL AND m IS NOT NULL)
"""


@query(_WINS + """
SELECT trait, model, count(*) FILTER (v = l[1] AND l[2] - l[1] > 2)::BIGINT AS wins, round(avg((v = l[1] AND l[2] - l[1] > 2)::INT::DOUBLE), 6) AS share, round(avg(v - l[1]), 3) AS mean_gap
FROM l GROUP BY ALL
""")
def model_wins(spark, sf_dir):
    """Over 20 replicates of each trait: how often each model wins, and its mean gap to the best."""
    models = ["urgent", "high", "medium"]
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("trait"), (F.col("o_custkey") % 20).alias("rep"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("model")).agg(F.avg("o_totalprice").alias("v"))
    out = stats.model_wins(stats.model_choice(rows, ["trait", "rep"], "model", "v", models), ["trait"], models)
    return out.select("trait", "model", "wins", F.round("share", 6).alias("share"), F.round("mean_gap", 3).alias("mean_gap"))


@query("""
WITH s AS (SELECT o_orderstatus AS s, o_custkey % 50 AS rep, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
t AS (SELECT s, min(v) AS t FROM (SELECT o_orderstatus AS s, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY 1),
e AS (SELECT rep, bool_and(v > t) AS a FROM s JOIN t USING (s) GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(a::INT::DOUBLE), 6) AS share FROM e
""")
def joint_tail_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "s")
    mean = lambda *by: orders.groupBy("s", *by).agg(F.avg("o_totalprice").alias("v"))
    out = stats.joint_tail_share(mean((F.col("o_custkey") % 50).alias("rep")), mean("o_orderpriority"), "rep", "s", "v")
    return out.select("n", F.round("share", 6).alias("share"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1, 2")
def status_frequencies(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("share", F.round("share", 9))


@query("""
SELECT coalesce(o_orderpriority, '') AS o_orderpriority, count(*)::BIGINT AS n, count(DISTINCT coalesce(o_orderstatus, '-'))::BIGINT AS n_distinct FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(*)::BIGINT, count(DISTINCT coalesce(o_orderstatus, '-'))::BIGINT FROM orders
""")
def distinct_overall(spark, sf_dir):
    return stats.distinct_overall(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_discount), 8) AS l_discount, round(avg(l_tax), 8) AS l_tax FROM lineitem GROUP BY 1, 2, 3")
def means_by_three_factors(spark, sf_dir):
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    out = stats.grouped_means(table(spark, sf_dir, "lineitem"), by, ["l_discount", "l_tax"])
    return out.select(*by, F.round("l_discount", 8).alias("l_discount"), F.round("l_tax", 8).alias("l_tax"))


@query("""
SELECT o_orderkey, o_custkey, count(*) OVER w AS group_n, min(o_totalprice) OVER w AS group_min, max(o_totalprice) OVER w AS group_max FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def group_sizes(spark, sf_dir):
    return stats.with_group_size(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", "group_n", "group_min", "group_max")


@query("""
WITH e AS (SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey FROM orders WHERE o_custkey IS NOT NULL)
SELECT *, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS n_members FROM e
""")
def members_of_fits(spark, sf_dir):
    """The customers that each comparison (priority) of each group (status) used."""
    return stats.members(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey")


@query("""
WITH w AS (SELECT c_mktsegment, min(c_acctbal) AS balance_least, max(c_acctbal) AS balance_most, min(c_custkey)::DOUBLE AS key_least, max(c_custkey)::DOUBLE AS key_most FROM customer GROUP BY 1)
SELECT c_mktsegment, split_part(n, '_', 1) AS trait, split_part(n, '_', 2) AS optimum, value FROM w UNPIVOT (value FOR n IN (balance_least, balance_most, key_least, key_most))
""")
def parsed_columns(spark, sf_dir):
    names = [f"{a}_{b}" for a in ("balance", "key") for b in ("least", "most")]
    b, k = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    wide = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(*[f(v).alias(n) for n, (v, f) in zip(names, [(b, F.min), (b, F.max), (k, F.min), (k, F.max)], strict=True)])
    return stats.parsed_long(wide, ["c_mktsegment"], names, "^([^_]*)_(.*)$", ["trait", "optimum"])


@query("""
WITH m AS (SELECT label, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS value FROM embeddings)
SELECT label, place::INTEGER AS place, count(value)::BIGINT AS n, round(avg(value), 7) AS value FROM m GROUP BY 1, 2
""")
def vector_means(spark, sf_dir):
    """Vectors as rows, averaged by label and place."""
    long = stats.melted(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), ["label"], "embedding")
    return long.groupBy("label", "place").agg(F.count("value").alias("n"), F.round(F.avg("value"), 7).alias("value"))


@query("SELECT vec_id, round(atan2(b, a), 9) AS radians, round(degrees(atan2(b, a)), 6) AS degrees FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)")
def vector_angles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    radians, degrees = measures.direction("a", "b")
    return e.select("vec_id", F.round(radians, 9).alias("radians"), F.round(degrees, 6).alias("degrees"))


@query("""
WITH s AS (SELECT c_custkey AS id, replace(c_name, ' ', '_') AS name, c_acctbal AS balance, c_nationkey AS k, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT s_suppkey, replace(s_name, ' ', '_'), s_acctbal, s_nationkey, NULL FROM supplier)
SELECT id, name, balance, segment, n_name AS nation FROM s JOIN nation ON k = n_nationkey
""")
def stacked_sets(spark, sf_dir):
    """Two sets under common names, one without a segment, stacked and merged with their nations."""
    names = {"custkey": "id", "name": "name", "acctbal": "balance", "nationkey": "k"}
    customers = measures.selected(table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'"), {f"c_{k}": v for k, v in names.items()} | {"c_mktsegment": "segment"}, "name")
    suppliers = measures.selected(table(spark, sf_dir, "supplier"), {f"s_{k}": v for k, v in ({"suppkey": "id"} | names).items() if k != "custkey"}, "name")
    nations = measures.selected(table(spark, sf_dir, "nation"), {"n_nationkey": "k", "n_name": "nation"})
    return measures.stacked(customers, suppliers).join(nations, "k").select("id", "name", "balance", "segment", "nation")


@query("""
SELECT o_orderkey, o_orderpriority, o_orderstatus, nullif(coalesce(list_position(['3-MEDIUM', '1-URGENT', '2-HIGH'], o_orderpriority), 0), 0)::BIGINT AS level FROM orders
WHERE regexp_matches(o_orderpriority, '^[1-4]') AND NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AND NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'O')
""")
def ordered_levels(spark, sf_dir):
    """Orders whose priority fits a pattern, without two pairs of levels, in the order of given levels and falling price."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").rlike("^[1-4]"))
    rows = measures.without_pairs(rows, "o_orderpriority", "o_orderstatus", [("1-URGENT", "F"), ("2-HIGH", "O")])
    out = measures.by_levels(rows, "o_orderpriority", ["3-MEDIUM", "1-URGENT", "2-HIGH"], F.desc("o_totalprice"), F.col("o_orderkey"))
    return out.select("o_orderkey", "o_orderpriority", "o_orderstatus", "level")


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_totalprice > 200000)
SELECT custkey, 'segment' AS only_in FROM a ANTI JOIN b USING (custkey) UNION ALL SELECT custkey, 'orders' FROM b ANTI JOIN a USING (custkey) WHERE custkey IS NOT NULL
""")
def key_differences(spark, sf_dir):
    """Customers of a segment without a large order, and those with one outside the segment."""
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    b = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("custkey"))
    return measures.key_differences(a, b, "custkey", ("segment", "orders"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_orderkey IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def unique_families(spark, sf_dir):
    """Orders whose line items all carry one flag."""
    return measures.unique_to_one(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 40)::DOUBLE AS d, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 30)::DOUBLE END AS m, (p_partkey % 25)::DOUBLE AS x FROM part)
SELECT p_partkey, least(a, d) AS dl, greatest(a, d) AS al, CASE WHEN m IS NOT NULL THEN least(m, x) END AS ml, CASE WHEN m IS NULL THEN x ELSE greatest(m, x) END AS xl FROM p
""")
def swapped_pairs(spark, sf_dir):
    """Records whose deviation or least value was entered in the place of its partner, put in order."""
    k = F.col("p_partkey")
    entry = F.create_map(F.lit("al"), F.col("p_size").cast("string"), F.lit("dl"), (k % 40).cast("string"), F.lit("xl"), (k % 25).cast("string"), F.lit("ml"), F.when(k % 3 != 0, (k % 30).cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", clean.in_order(F.map_filter(entry, lambda _, v: v.isNotNull())).alias("e"))
    return rows.select("p_partkey", *[clean.number(F.col("e"), n).alias(n) for n in ("dl", "al", "ml", "xl")])


_WS = r"[ \t\n\x0B\f\r]"
_CHAIN = rf"""
WITH v AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(coalesce(text, ''), '([^ \t\n\x0B\f\r])', '\1 ', 'g') WHEN doc_id % 5 = 0 THEN substr(coalesce(text, ''), 1, 400) ELSE coalesce(text, '') END AS f FROM documents),
w AS (SELECT *, substr(f, 1, 3000) AS p, len(regexp_extract_all(substr(f, 1, 3000), '[^ \t\n\x0B\f\r]+')) AS n FROM v),
m AS (SELECT *, CASE WHEN n > 0 THEN length(regexp_replace(p, '{_WS}', '', 'g')) / n ELSE 0 END AS mean FROM w),
q AS (SELECT doc_id, CASE WHEN mean < 2 AND n > 150 THEN 'thinned' WHEN mean > 8 OR n < 150 THEN 'second' ELSE 'first' END AS route, t, f FROM m),
used AS MATERIALIZED (SELECT doc_id, route, regexp_replace(regexp_replace(CASE route WHEN 'thinned' THEN regexp_replace(f, '{_WS}({_WS}*)', '\1', 'g') WHEN 'second' THEN t ELSE f END, '[^\x20-\x7E\t\n\x0B\f\r]', '?', 'g'), '{_WS}+', ' ', 'g') AS text FROM q),
"""
_CHAIN += (_TERMS.replace("WITH w AS", "fw AS").replace("FROM w GROUP", "FROM fw GROUP").replace("documents", "used").strip() + r""",
pt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, n DESC, word) AS place FROM r),
vv AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM used),
ii AS (SELECT doc_id, word, place, ws, list_position(ws, word) AS i FROM pt JOIN vv USING (doc_id) WHERE place <= 5),
bb AS (SELECT *, CASE WHEN i > 1 THEN ws[i - 1] WHEN i = 1 THEN ws[len(ws)] END AS before FROM ii),
nn AS (SELECT *, coalesce(length(before) > 3 AND regexp_matches(before, '^[A-Z]'), false) AS named FROM bb),
names AS (SELECT doc_id, coalesce(arg_min(before, place) FILTER (named), '') AS first_name, coalesce(arg_min(word, place) FILTER (named), arg_min(word, place)) AS second_name FROM nn GROUP BY 1),
""" + rf"""
kk AS (SELECT doc_id, text, unnest(range(greatest(length(text) // 20, 1))) * 20 AS start FROM used WHERE length(text) >= 400),
ss AS (SELECT doc_id, start, substr(text, start + 1, 400) AS s FROM kk), cc AS (
  SELECT doc_id, start, s, {_SCORE} + CASE WHEN length(regexp_replace(s, '[^0-9]', '', 'g')) > 3 THEN 2 ELSE 0 END AS score FROM ss),
best AS (SELECT doc_id, arg_max(start, score * 1000000000 - start) AS start, max(score) AS score, arg_max(s, score * 1000000000 - start) AS p FROM cc WHERE score > 0 GROUP BY 1),
""")


def _near_sql(name: str, words: list[str]) -> str:
    """Place of the first keyword in ``best.p`` and the number nearest to it."""
    at = ", ".join(f"nullif(instr(p, '{w}'), 0)" for w in words)
    return rf"""{name}h AS (SELECT doc_id, coalesce({at}) AS pos, substr(p, 1, pos - 1) AS l, substr(p, pos + 1) AS r FROM best),
{name}f AS (SELECT *, CASE WHEN regexp_matches(l, '[0-9]') THEN length(regexp_extract(l, '(?s)[0-9]([^0-9]*)$', 1)) END AS fl, CASE WHEN regexp_matches(r, '[0-9]') THEN length(regexp_extract(r, '(?s)^([^0-9]*)[0-9]', 1)) END AS fr FROM {name}h),
{name}n AS (SELECT doc_id, pos::INTEGER AS {name}_at, regexp_replace(CASE WHEN fl IS NULL AND fr IS NULL THEN NULL WHEN fl IS NOT NULL AND (fr IS NULL OR fl <= fr) THEN regexp_extract(l, '(?s)([^A-Za-z]*[0-9])[^0-9]*$', 1) ELSE regexp_extract(r, '(?s)^[^0-9]*([0-9][^A-Za-z]*)', 1) END, '^[\s!-/:-@\[-`{{-~]+|[\s!-/:-@\[-`{{-~]+$', '', 'g') AS {name}_number FROM {name}f),
"""


_KINDS = {"length": ["mm", "long", "the"], "width": ["wide", "width", "de"]}


@query(_CHAIN + "".join(_near_sql(k, w) for k, w in _KINDS.items()) + """
last AS (SELECT 1)
SELECT u.doc_id, route, len(regexp_extract_all(u.text, '[^ ]+')) < 150 AS low_text, first_name, second_name, start::INTEGER AS start, score::INTEGER AS score, length_at, length_number, width_at, width_number,
  CASE WHEN start IS NULL THEN 'no window' WHEN coalesce(length_at, width_at) IS NULL THEN 'no keyword' WHEN coalesce(length_number, width_number) IS NULL THEN 'no number' ELSE 'mined' END AS status
FROM used u LEFT JOIN names USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN lengthn USING (doc_id) LEFT JOIN widthn USING (doc_id)
""")
def mining_chain(spark, sf_dir):
    """Documents through the whole chain; every seventh is letter-spaced and every fifth cut short in its first source."""
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    first = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(text, r"([^ \t\n\x0B\f\r])", "$1 ")).when(F.col("doc_id") % 5 == 0, F.substring(text, 1, 400)).otherwise(text)
    docs = docs.select("doc_id", first.alias("first"), text.alias("second")).withColumn("sample", F.substring("first", 1, 3000))
    return textmine.mine_corpus(docs, "doc_id", "sample", "first", "second", _KINDS)


_CLIPS = """
WITH c AS (SELECT p_partkey // 3 AS rec, p_partkey AS o, ['p', 'a', 'm', 'd', 'x'][p_partkey % 5 + 1] AS m, ['l', 'w', 'b'][p_size % 3 + 1] AS s,
    CASE WHEN p_partkey % 4 = 0 THEN p_size || ',5' WHEN p_partkey % 11 = 0 THEN p_brand || ' none' ELSE p_size || ' mm x ' || (p_partkey % 9) || '.25' END AS t FROM part),
n AS (SELECT *, regexp_extract(t, '^[^0-9]*([0-9]+[.,]?[0-9]*)[^0-9.,]+([0-9]+[.,]?[0-9]*)[^0-9]*$', ['a', 'b']) AS g, regexp_matches(t, '^[^0-9]*([0-9]+[.,]?[0-9]*)[^0-9.,]+([0-9]+[.,]?[0-9]*)[^0-9]*$') AS two FROM c),
k AS (SELECT rec, o, CASE WHEN NOT two THEN m || s WHEN m = 'p' THEN 'pl' WHEN m IN ('a', 'd') THEN 'a' || s ELSE 'm' || s END AS key, CASE WHEN two THEN replace(g.a, ',', '.') ELSE t END AS value FROM n UNION ALL
  SELECT rec, o, CASE WHEN m = 'p' THEN 'pw' WHEN m IN ('a', 'd') THEN 'd' || s ELSE 'x' || s END, replace(g.b, ',', '.') FROM n WHERE two),
l AS (SELECT rec, key, arg_max(value, o) AS value FROM k GROUP BY 1, 2)
SELECT rec, string_agg(key || '=' || value, ';' ORDER BY key) AS entry FROM l GROUP BY 1
"""


@query(_CLIPS)
def clip_records(spark, sf_dir):
    """Clips made from parts, three to a record."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(size, F.lit(",5"))).when(k % 11 == 0, F.concat("p_brand", F.lit(" none"))).otherwise(F.concat(size, F.lit(" mm x "), (k % 9).cast("string"), F.lit(".25")))
    pick = lambda letters, i: F.element_at(F.array(*map(F.lit, letters)), (i + 1).cast("int"))
    clips = table(spark, sf_dir, "part").select(F.floor(k / 3).alias("rec"), k.alias("o"), pick("pamdx", k % 5).alias("m"), pick("lwb", F.col("p_size") % 3).alias("s"), text.alias("t"))
    pairs = F.transform(F.array_sort(F.map_entries("entry")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return textmine.merged_clips(clips, "rec", "o", "m", "s", "t").select("rec", F.array_join(pairs, ";").alias("entry"))


@query("""
WITH p AS (SELECT r_name AS region, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS nation, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment, 'g' || c_custkey % 40 AS genus, c_name AS tip
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT region, nation, nullif(segment, '') AS segment, genus, tip FROM p),
l AS (SELECT 'region' AS rank, region AS taxon, NULL AS ur, NULL AS ut, tip FROM f UNION ALL SELECT 'nation', nation, 'region', region, tip FROM f WHERE nation IS NOT NULL UNION ALL
  SELECT 'segment', segment, CASE WHEN nation IS NULL THEN 'region' ELSE 'nation' END, coalesce(nation, region), tip FROM f WHERE segment IS NOT NULL UNION ALL
  SELECT 'genus', genus, CASE WHEN segment IS NOT NULL THEN 'segment' WHEN nation IS NOT NULL THEN 'nation' ELSE 'region' END, coalesce(segment, nation, region), tip FROM f),
u AS (SELECT rank, taxon, ur, ut, count(*) AS c FROM l GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY rank, taxon ORDER BY c DESC, ur, ut) AS i FROM u),
n AS (SELECT rank, taxon, count(*) AS n, count(DISTINCT tip) AS tips FROM l GROUP BY 1, 2)
SELECT n.rank, n.taxon, ur AS parent_rank, ut AS parent, (SELECT count(*) FROM u WHERE u.rank = n.rank AND u.taxon = n.taxon AND ut IS NOT NULL) AS parents, n, tips, total
FROM n JOIN b ON b.rank = n.rank AND b.taxon = n.taxon AND i = 1 LEFT JOIN (SELECT 'nation' AS rank, n_name AS taxon, count(*) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2) t ON t.rank = n.rank AND t.taxon = n.taxon
""")
def taxon_lineages(spark, sf_dir):
    """Taxa of four ranks with gaps: parents through gaps, conflicts among them, records, tips and known totals."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("region"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("nation"), F.when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.concat(F.lit("g"), (k % 40).cast("string")).alias("genus"), "c_name")
    totals = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("taxon")).agg(F.count("*").alias("total")).withColumn("rank", F.lit("nation"))
    return classify.lineage_counts(rows, ["region", "nation", "segment", "genus"], "c_name", totals)


_LOOP = """
WITH e AS (SELECT p_partkey AS k, p_size::DOUBLE AS s FROM part),
b AS (SELECT k, s, CASE WHEN k % 5 = 0 OR k % 3 <> 0 OR k % 11 = 0 OR k % 13 = 0 THEN 'rnsd' WHEN k % 17 = 0 THEN 'comp' WHEN s > 30 OR k % 6 = 0 OR (0.5 >= s) THEN 'cols' ELSE 'sqky' END AS before,
  k % 17 = 0 AND (k % 3 <> 0) <> (k % 5 = 0) AS moved FROM e),
f AS (SELECT *, CASE WHEN k % 6 = 0 THEN 99 WHEN k % 3 = 0 THEN 0.5 WHEN moved THEN 7 END AS d FROM b),
o AS (SELECT *, CASE WHEN d >= s THEN d ELSE s END AS al, CASE WHEN d >= s THEN s ELSE d END AS dl FROM f),
a AS (SELECT k, before, CASE WHEN before = 'sqky' THEN 'sqky' WHEN (k % 3 <> 0 AND NOT moved) OR (k % 5 = 0 AND NOT moved) OR (moved AND k % 3 <> 0 AND k % 5 = 0) OR k % 13 = 0 THEN 'rnsd' WHEN k % 17 = 0 AND NOT moved THEN 'comp'
  WHEN k % 5 = 0 OR al > 30 OR dl > 30 OR dl >= al THEN 'cols' ELSE 'sqky' END AS status FROM o)
"""


@query(_LOOP + """
, c AS (SELECT count(*) AS n, count_if(before = 'sqky') AS g, count_if(k % 11 = 0) AS c, count_if(status = 'sqky') AS a, count_if(status <> 'sqky') AS q FROM a)
SELECT before, status, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT 'records', '', n FROM c UNION ALL SELECT 'good before', '', g FROM c UNION ALL SELECT 'corrected', '', c FROM c UNION ALL SELECT 'good after', '', a FROM c UNION ALL SELECT 'quarantined', '', q FROM c
""")
def cleaning_loop(spark, sf_dir):
    """Records of parts with faults: missing references are corrected, stray halves moved, orders repaired, the rest quarantined."""
    records = _entries(spark, sf_dir)
    fixes = records.where("p_partkey % 11 = 0").select(F.col("p_partkey").cast("string").alias("ID"), F.lit("b").alias("key"), F.lit("r").alias("new_value"))
    good, bad, counts = clean.cleaning_loop(records, "entry", fixes)
    by_status = good.select("before", "status").unionByName(bad.select("before", "status")).groupBy("before", "status").agg(F.count("*").alias("n"))
    return by_status.unionByName(spark.createDataFrame([(k, "", v) for k, v in counts.items()], "before string, status string, n long"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT p_partkey::VARCHAR AS "ID", 'it''s "' || p_type || '"' AS g, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.50' END AS al, p_partkey % 7 = 0 AS literal FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 11 = 0
""")
def entry_files(spark, sf_dir):
    """Records of parts written a dict a line, some as literals that are no JSON and some broken, read back and made wide."""
    k = F.col("p_partkey")
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in (("ID", k.cast("string")), ("g", F.concat(F.lit("it's \""), "p_type", F.lit("\""))), ("al", F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".50")))))]), lambda e: e["value"].isNotNull())
    parts = table(spark, sf_dir, "part").select("p_partkey", F.map_from_entries(pairs).alias("entry"))
    plain, literal, broken = (_folder(spark, n) for n in ("entries", "literals", "broken"))
    files.write_entries(parts.where("p_partkey % 11 <> 0 and p_partkey % 7 <> 0"), "entry", plain)
    # As another writer would put it: escaped single quotes, a trailing comma, a mark of its own.
    text = F.array_join(F.transform(F.map_entries("entry"), lambda e: F.concat(F.lit("u'"), e["key"], F.lit("': u'"), F.replace(e["value"], F.lit("'"), F.lit("\\'")), F.lit("'"))), ", ")
    parts.where("p_partkey % 11 <> 0 and p_partkey % 7 = 0").select(F.concat(F.lit("{"), text, F.lit(", u'lit': 'y',}"))).write.text(literal)
    parts.where("p_partkey % 11 = 0").select(F.concat(F.lit("{'ID': "), F.col("p_partkey").cast("string"))).write.text(broken)
    read = files.read_entries(spark, [plain, literal, broken])
    wide = files.widened(read, "entry", ["ID", "g", "al", "lit"])
    return wide.select("ID", "g", "al", F.when(F.col("ID").isNotNull(), F.col("lit").isNotNull()).alias("literal"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS state, (o_orderkey % 90) || '.50' AS digits FROM orders
""")
def table_files(spark, sf_dir):
    """Orders as tab-separated text with NA for missing numbers, read with types and once more all as text."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 != 0, F.col("o_totalprice")).cast("string").alias("price"), F.when(k % 7 == 0, "").otherwise(F.col("o_orderstatus")).alias("state"), F.concat((k % 90).cast("string"), F.lit(".50")).alias("digits"))
    with_head, headless = _folder(spark, "table"), _folder(spark, "ids")
    files.write_table(rows.withColumn("price", F.coalesce("price", F.lit("NA"))), with_head)
    files.write_table(rows.select("o_orderkey", "digits"), headless, header=False)
    typed = files.read_table(spark, with_head, "o_orderkey long, price double, state string, digits double").drop("digits")
    texts = files.read_texts(spark, headless, ["key", "digits"], header=False).select(F.col("key").cast("long").alias("o_orderkey"), "digits")
    return typed.join(texts, "o_orderkey").select("o_orderkey", "price", F.coalesce("state", F.lit("")).alias("state"), "digits")


@query("""
WITH r AS (SELECT p_brand AS order1, 'b' || p_partkey // 2 AS b, max(p_partkey) AS k FROM part GROUP BY 1, 2),
d AS (SELECT 'b' || p_partkey // 2 AS b FROM part WHERE p_partkey % 10 = 4),
e AS (SELECT p_partkey AS k, p_brand AS order1, 'b' || p_partkey // 2 || CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE '' END AS b FROM part)
SELECT e.k AS p_partkey, 'T ' || r.k AS title, r.k IS NOT NULL AS attached FROM e LEFT JOIN r USING (order1, b) WHERE e.b NOT IN (SELECT b FROM d)
""")
def reference_files(spark, sf_dir):
    """A reference list per order, a done list, and entries that get the last reference of their order and id unless they are finished."""
    part = table(spark, sf_dir, "part")
    k, folder, done = F.col("p_partkey"), _folder(spark, "references"), _folder(spark, "done")
    bib = F.concat(F.lit("b"), F.floor(k / 2).cast("string"))
    # Both ways of writing a field; of two parts with one id the later line holds.
    field = F.when(k % 2 == 0, F.concat(F.lit(" title={T "), k.cast("string"), F.lit("},"))).otherwise(F.concat(F.lit(" title = {T "), k.cast("string"), F.lit("},")))
    entry = F.concat_ws("\n", F.concat(F.lit("@article{"), bib, F.lit(",")), field, F.lit(" year = {1999}"), F.lit("}"))
    part.select(F.col("p_brand").alias("order1"), k, entry.alias("value")).repartition(1, "order1").sortWithinPartitions("order1", "p_partkey").select("order1", "value").write.partitionBy("order1").text(folder)
    part.where("p_partkey % 10 = 4").select(F.when(k % 20 == 4, bib).otherwise(F.concat(bib, F.lit(" : #NO pdf")))).write.text(done)
    refs = files.last_reference(files.read_references(spark, folder), ("order1", "bib_id"))
    refs = refs.select("order1", F.col("bib_id").alias("b"), F.element_at("fields", "title").alias("title"))
    entries = part.select(k, F.col("p_brand").alias("order1"), F.concat(bib, F.when(k % 9 == 0, "x").otherwise("")).alias("b"), F.lit(None).cast("string").alias("title"))
    todo = measures.not_in_keys(entries, files.read_done(spark, done).select(F.col("bib_id").alias("b")), "b")
    attached, without = keys.with_references(todo, refs, ["order1", "b"], "title")
    return measures.stacked(attached.withColumn("attached", F.lit(True)), without.withColumn("attached", F.lit(False))).select("p_partkey", "title", "attached")


@query("""
WITH v AS (SELECT c_nationkey AS rep, c_mktsegment AS trait, avg(c_acctbal) AS mean, max(c_acctbal) AS most FROM customer GROUP BY 1, 2)
SELECT trait, what, round(quantile_cont(value, 0.025), 4) AS low, round(quantile_cont(value, 0.975), 4) AS high FROM (SELECT trait, 'mean' AS what, mean AS value FROM v UNION ALL SELECT trait, 'most', most FROM v) GROUP BY 1, 2
""")
def replicate_files(spark, sf_dir):
    """A file per replicate, a column per trait and figure; read with the replicate from the path, made long by the columns' names, intervals of each."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("rep"), F.col("c_mktsegment").alias("trait")).agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("most"))
    traits = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    long = rows.select("rep", F.inline(F.array(*[F.struct(F.concat("trait", F.lit(f".{c}")).alias("name"), F.col(c).alias("value")) for c in ("mean", "most")])))
    names = [f"{t}.{c}" for t in traits for c in ("mean", "most")]
    wide = stats.long_to_wide(long, ["rep"], "name", "value", names)
    folder = _folder(spark, "replicates")
    wide.withColumnsRenamed({n: n.replace(".", "_") for n in names}).repartition(1, "rep").write.partitionBy("rep").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(folder)
    columns = [n.replace(".", "_") for n in names]
    read = files.read_replicates(spark, f"{folder}/rep=*", ", ".join(f"{c} double" for c in columns), "rep=([0-9]+)")
    parsed = stats.parsed_long(read, ["replicate"], columns, "^(.*)_(.*)$", ["trait", "what"])
    out = stats.quantiles(parsed, ["trait", "what"], "value", {"low": 0.025, "high": 0.975})
    return out.select("trait", "what", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""
SELECT lower(c_mktsegment) AS order1, c_custkey::VARCHAR AS "ID", CASE WHEN c_custkey % 5 <> 0 THEN c_name || ' ''s' END AS g,
  round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS log_al, round(CASE WHEN c_nationkey > 0 THEN log10(c_nationkey) END, 6) AS log_aw
FROM customer WHERE c_custkey % 13 <> 0
""")
def order_files(spark, sf_dir):
    """Records in a folder per order as one table with the order from the path, then the logarithms of their figures; broken and blank lines fall."""
    k = F.col("c_custkey")
    pairs = F.create_map(F.lit("ID"), k.cast("string"), F.lit("g"), F.when(k % 5 != 0, F.concat("c_name", F.lit(" 's"))), F.lit("al"), F.col("c_acctbal").cast("string"), F.lit("aw"), F.col("c_nationkey").cast("string"))
    line = F.when(k % 13 != 0, F.to_json(F.map_filter(pairs, lambda _, v: v.isNotNull()))).when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("{'ID': "))
    folder = _folder(spark, "orders")
    table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("data"), line.alias("value")).write.partitionBy("data").text(folder)
    read = files.parsed_entries(files.read_by_order(spark, f"{folder}/data=*", "data=([^/]+)/")).where("not bad")
    wide = files.widened(read, "entry", ["ID", "g", "al", "aw"], keep=["order1"]).withColumns({c: F.col(c).try_cast("double") for c in ("al", "aw")})
    logs = measures.log_family({"log_al": "al", "log_aw": "aw"})
    return wide.select("order1", "ID", "g", *[F.round(v, 6).alias(n) for n, v in logs.items()])


@query("""
WITH v AS (SELECT n_name AS analysis, c_mktsegment AS model, round(avg(c_acctbal), 3) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT analysis, model, value FROM v WHERE model IN ('BUILDING', 'FURNITURE', 'MACHINERY')
""")
def result_files(spark, sf_dir):
    """A text file per analysis whose lines after the first end with a model's figure."""
    models = ["BUILDING", "FURNITURE", "MACHINERY"]
    mean = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("analysis")).pivot("c_mktsegment", models).agg(F.round(F.avg("c_acctbal"), 3))
    lines = [F.lit("models")] + [F.concat(F.lit(f"{m} criterion "), F.coalesce(F.col(m).cast("decimal(12,3)").cast("string"), F.lit("NA"))) for m in models]
    folder = _folder(spark, "results")
    mean.select("analysis", F.concat_ws("\n", *lines).alias("value")).repartition(1, "analysis").write.partitionBy("analysis").text(folder)
    return files.read_results(spark, f"{folder}/analysis=*", models, "analysis=([^/]+)/").where("value is not null")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS s FROM orders),
b AS (SELECT o_custkey, o_orderkey, s, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, md5('9/' || o_orderkey)) AS i FROM o)
SELECT c_custkey, o_orderkey, s, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'both' WHEN n_name = 'NATION_3' THEN 'third' WHEN r_name = 'ASIA' THEN 'first' ELSE 'none' END AS kind,
  CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'other' END AS mark, c_acctbal::DECIMAL(12, 1)::VARCHAR AS shown
FROM customer JOIN b ON o_custkey = c_custkey AND i = 1 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) AND c_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)
""".replace("c_acctbal::DECIMAL(12, 1)::VARCHAR AS shown", "printf('%.2f - %.2f', c_custkey % 50 / 4.0, c_custkey % 50 / 4.0 + 1) AS shown"))
def states_and_marks(spark, sf_dir):
    """One order per customer preferring the higher state, a cascade of several states, an overlay, key filters, a printed span."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("s"))
    best = dedup.first_per(orders, "o_custkey", F.desc("s"), dedup.draw("o_orderkey", 9))
    rules = spark.createDataFrame([("region", "ASIA", "1"), ("nation", "NATION_3", "3"), ("segment", "MACHINERY", "1"), ("segment", "MACHINERY", "2")], "rank string, name string, state string")
    kinds = classify.cascade(_places(spark, sf_dir), rules, ["region", "nation", "segment"], {"1": "first", "2": "both", "3": "third"}, "none", "kind")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    customers = classify.overlay(customers, customers.where("c_acctbal > 5000"), "c_custkey", "mark", "rich", "other")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    kept = measures.in_keys(customers, rich, "c_nationkey")
    kept = measures.not_in_keys(kept, table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("c_custkey")), "c_custkey")
    at = (F.col("c_custkey") % 50 / 4).cast("decimal(8,3)")
    out = kept.join(best.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").join(kinds.select("c_custkey", "kind"), "c_custkey")
    return out.select("c_custkey", "o_orderkey", "s", "kind", "mark", measures.span_text(at, at + 1).alias("shown"))


@query("""
WITH g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT c_nationkey FROM customer)),
v AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, median(c_acctbal) AS mid FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, coalesce(n, 0) AS n, round(mid, 6) AS mid FROM g LEFT JOIN v USING (c_mktsegment, c_nationkey)
""")
def result_grid(spark, sf_dir):
    """All combinations of two parameters with the median of each, also where there is no result."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    found = stats.medians(rows.where("c_acctbal > 5000"), ["c_mktsegment", "c_nationkey"], "c_acctbal", "mid")
    return stats.grid(rows, ["c_mktsegment", "c_nationkey"]).join(found, ["c_mktsegment", "c_nationkey"], "left").select("c_mktsegment", "c_nationkey", F.coalesce("n", F.lit(0)).alias("n"), F.round("mid", 6).alias("mid"))


@query("""
WITH l AS (SELECT p_partkey AS k, concat('{ID: ', p_partkey, '}') AS line FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0)
SELECT line FROM l UNION ALL SELECT line FROM l WHERE k % 5 = 0
""")
def new_record_lines(spark, sf_dir):
    """Record lines of a batch that the table lacks; some lines are cut off, some repeat inside the batch."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("{ID: "), k.cast("string"), F.lit("}"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 7 == 0, F.substring_index(line, "}", 1)).otherwise(line).alias("line"))
    batch = part.select("line").unionByName(part.where("p_partkey % 5 = 0").select("line"))
    return keys.new_lines(batch, part.where("p_partkey % 3 = 0"), "line").select("line")


@query("""
WITH e AS (SELECT p_partkey AS k, p_size::VARCHAR AS al, p_partkey % 7 = 0 AS p, p_partkey % 3 <> 0 AS half_l, p_partkey % 5 = 0 AS half_w FROM part)
SELECT k AS p_partkey, p AS conflict, NOT half_l AND NOT p AS good, CASE WHEN p THEN '3' WHEN half_l AND NOT half_w THEN al END AS point_l, CASE WHEN half_w AND NOT half_l THEN 'x1' END AS point_w FROM e
""")
def repaired_records(spark, sf_dir):
    """Conflicting kinds, whole dimensions, and lone halves as single values."""
    point = F.when(F.col("p_partkey") % 7 == 0, F.create_map(F.lit("pl"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = _entries(spark, sf_dir).select("p_partkey", F.map_concat("entry", point).alias("entry"))
    fixed = rows.withColumn("fixed", clean.as_point("entry"))
    return fixed.select("p_partkey", (F.size(clean.conflicting("entry")) > 0).alias("conflict"), clean.dimension_is_good("entry", "l").alias("good"), *[F.element_at("fixed", f"p{d}").alias(f"point_{d}") for d in "lw"])


@query("""
WITH e AS (SELECT p_partkey AS k, p_brand AS b, 'G' || p_size AS g, 's' || p_partkey % 3 AS s, CASE WHEN p_partkey % 4 = 0 THEN 'M' || p_partkey % 10 END AS m FROM part),
f AS (SELECT p_brand AS b, 'G' || p_size || ' s1' AS t, max('n' || p_partkey) AS v FROM part WHERE p_partkey % 6 = 0 GROUP BY 1, 2 UNION ALL SELECT DISTINCT p_brand, 'M4', 'matched' FROM part WHERE p_size > 25)
SELECT k AS p_partkey, coalesce(f.v, h.v) AS note, coalesce(f.v, h.v) IS NOT NULL AS checked FROM e LEFT JOIN f ON f.b = e.b AND f.t = m LEFT JOIN f h ON h.b = e.b AND h.t = g || ' ' || s
""")
def corrections_by_taxon(spark, sf_dir):
    """Corrections that name a reference and a taxon: a matched name comes before genus and species."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pairs = {"b": F.col("p_brand"), "g": F.concat(F.lit("G"), F.col("p_size").cast("string")), "s": F.concat(F.lit("s"), (k % 3).cast("string")), "tax_matched": F.when(k % 4 == 0, F.concat(F.lit("M"), (k % 10).cast("string")))}
    entry = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs.items()]), lambda e: e["value"].isNotNull()))
    plain = part.where("p_partkey % 6 = 0").select(F.col("p_brand").alias("b"), F.concat(F.lit("G"), F.col("p_size").cast("string"), F.lit("_s1")).alias("taxon"), F.lit("tax_note").alias("key"), F.concat(F.lit("n"), k.cast("string")).alias("new_value"))
    matched = part.where("p_size > 25").select(F.col("p_brand").alias("b"), F.lit("M4").alias("taxon"), F.lit("tax_note").alias("key"), F.lit("matched").alias("new_value"))
    out = clean.corrected_by_taxon(part.select("p_partkey", entry.alias("e")), "e", plain.unionByName(matched))
    return out.select("p_partkey", F.element_at("e", "tax_note").alias("note"), F.map_contains_key("e", F.lit("dbl_chk")).alias("checked"))
