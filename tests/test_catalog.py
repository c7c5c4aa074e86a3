"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from gaugeweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def answers(spark, request):
    """Columns and rows of the queries asked for, four at a time: on small tables they wait more than they work."""
    def ask(name):
        got = catalog.QUERIES[name](spark, SF)
        return got.columns, got.collect()

    names = [i.callspec.params["name"] for i in request.session.items if i.name.startswith("test_query_equals_sql")]
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(ask, name) for name in names}


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(answers, duck, name):
    got, found = answers[name].result()
    want = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got) == sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in found)
    other = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in want.fetchall())
    assert rows == other


def test_tests_of_slopes_agree_with_the_fits(spark):
    fits = {r["tree_id"]: r for r in catalog.QUERIES["tree_regressions"](spark, SF).collect()}
    rows = catalog.QUERIES["tree_regression_tests"](spark, SF).collect()
    assert {r["tree_id"] for r in rows} == set(fits)
    for r in rows:
        assert r["slope"] == pytest.approx(fits[r["tree_id"]]["slope"], abs=1e-6) and 0 <= r["p"] <= 1 and r["n"] == fits[r["tree_id"]]["n"]


def test_models_and_hulls_of_the_tables(spark):
    best = catalog.QUERIES["tree_models"](spark, SF).collect()
    assert len(best) == 5 and {r["model"] for r in best} <= {"brownian", "white", "lambda", "early", "pull"} and all(math.isfinite(r["aicc"]) for r in best)
    labels = spark.read.parquet(f"{SF}/embeddings.parquet").select("label").distinct().count()
    corners = catalog.QUERIES["vector_hulls"](spark, SF).collect()
    assert len({r["label"] for r in corners}) == labels
