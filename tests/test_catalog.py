"""Every query with SQL gives the same rows in both engines."""

import math

import duckdb
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
# The whole sets are checked once each; of the small feature queries a few, since they are columns of the sets.
NAMES = [n for n in catalog.ORACLES if n not in catalog.FEATURE_QUERIES or n.startswith("features_") or n == "cond_entropy"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(frame, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours, sorted(ours.columns)) == canon(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"stack_model"}))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_feature_names_and_counts():
    from quillon.functions.sql import SPARK
    from quillon.operators.features import REGISTRY

    sizes = {n: build(SPARK).last.split(" FROM ")[0].count(" AS DOUBLE) AS ") for n, (_, build) in REGISTRY.items()}
    assert sum(f.count("") > 0 for f in sizes) == 5
    assert sizes["actions"] == 75 and sizes["temporal"] == 39 and sizes["context"] == 22


def test_perhand_and_hero_counts(spark, sf):
    assert len(catalog.QUERIES["features_perhand"](spark, sf).columns) == 294
    assert len(catalog.QUERIES["features_hero"](spark, sf).columns) == 177


@pytest.mark.parametrize(("name", "columns"), [("ema_scores", {"user_id", "ts", "value"}), ("served_registry", {"user_id", "ts", "event_type"}), ("audit_evidence", {"o_custkey", "o_totalprice"})])
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    import re

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",")}
    assert read == columns and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", [f"features_{n}" for n in ("actions", "temporal", "context", "perhand", "hero")])
def test_feature_sets_move_no_row(spark, sf, name):
    """Tables are in buckets of chunk_id, and all that a set groups, joins and windows by is within a chunk."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0, plan.count("Exchange hashpartitioning")
