"""Every query with SQL against DuckDB at the smallest scale; every other one must run."""

import math
import os

import duckdb
import pytest

from sievewright.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are needed")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(map(shown, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"tree_shap_additivity"}))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_contributions_add_up_to_the_margin(spark):
    assert catalog.QUERIES["tree_shap_additivity"](spark, DATA).agg({"gap": "max"}).first()[0] < 1e-9


@pytest.mark.parametrize("name", ["gbt_fit_score", "tree_shap_additivity"])
def test_models_score_every_row(spark, name):
    rows = lambda df: sorted(map(tuple, df.select("l_orderkey", "l_linenumber").collect()))
    assert rows(catalog.QUERIES[name](spark, DATA)) == rows(spark.read.parquet(f"{DATA}/lineitem.parquet"))


def test_regression_is_fitted_on_every_row(spark):
    """At the optimum the mean of the predictions is the mean of the labels of the rows that were fitted."""
    w = {r["feature"]: r["weight"] for r in catalog.QUERIES["lr_fit"](spark, DATA).collect()}
    margin = " + ".join([f"{v!r}D" if f == "(bias)" else f"{v!r}D * {f}" for f, v in w.items()])
    r = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("count(1) AS n", f"avg(1 / (1 + exp(-({margin})))) - avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS gap").first()
    assert r["n"] > 0 and abs(r["gap"]) < 1e-4
