"""Every registered query against its SQL on the smallest tables."""

import functools
import math
import os

import duckdb
import pandas as pd
import pytest

from nexuloom import catalogue
from nexuloom.plans import kg
from nexuloom.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_kept_graph():
    """Here the queries over the kept graph share one; elsewhere each makes its own."""
    own = {n: getattr(kg, n) for n in ("_scored", "_kept_parts", "_small")}
    kg._scored = functools.cache(lambda spark, sf: stage(own["_scored"](spark, sf), "scored"))
    kg._kept_parts, kg._small = functools.cache(own["_kept_parts"]), functools.cache(own["_small"])
    yield
    for n, f in own.items():
        setattr(kg, n, f)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, int | float) and not isinstance(v, bool):
        return round(float(v), 9) + 0.0
    return str(v)


def rows(d):
    cols = sorted(d.columns)
    return cols, sorted((tuple(map(plain, r)) for r in d[cols].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, name):
    d = catalogue.QUERIES[name](spark, SF)
    assert d.columns
    assert rows(d.toPandas()) == rows(catalogue.QUERIES[name](spark, SF).toPandas())


def test_repair_keeps_caps_and_links(spark):
    from nexuloom.plans import kg

    g = kg._run(spark, SF)
    kept = g.kept.toPandas()
    assert kept.groupby("category").size().max() <= kg.PARAMS.per_category_cap and kept["node"].is_unique
    assert set(kept["node"]) <= set(g.scored.toPandas()["node"])


def test_node_budget(spark):
    d = catalogue.QUERIES["node_budget_quota"](spark, SF).toPandas()
    assert len(d) == 100 and d["is_seed"].sum() == 5
    sizes = d[~d["is_seed"]].groupby("cluster").size()
    assert sizes.min() >= 3 and sizes.sum() == 95
