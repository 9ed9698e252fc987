"""Whole feature sets on generated hands against the plain Python version."""

import json
import math
import random

import plain_features
import pytest
from pyspark.sql import functions as F

from quillon.operators.features import REGISTRY, compute
from quillon.operators.longform import HAND_DDL, long_tables

KINDS = ("fold", "check", "call", "bet", "raise", "all_in", "small_blind", "big_blind")


def generated_hand(rng, table):
    seats = rng.sample(range(1, 7), rng.choice(table))
    pot, actions = 0.03, []
    for street in plain_features.STREETS[: rng.choice((1, 1, 2, 3, 4, 4))]:
        for _ in range(rng.randint(0, 9)):
            kind = rng.choice(KINDS if street == "preflop" else KINDS[:6])
            amount = 0.0 if kind in ("fold", "check") else rng.choice((0.02, 0.05, 0.06, 0.1, 0.11, 0.33, round(pot / 2, 2), round(rng.random(), 2)))
            after = round(pot + amount, 2)
            raise_to = round(2 * amount, 2) if kind in ("raise", "all_in") and rng.random() < 0.9 else None
            actions.append({"street": street, "actor_seat": rng.choice(seats) if rng.random() < 0.97 else 0, "action_type": kind, "amount": amount, "normalized_amount_bb": amount / 0.02, "pot_before": pot, "pot_after": after, "raise_to": raise_to, "call_to": amount if kind == "call" else None})
            pot = after
    return {
        "metadata": {"max_seats": rng.choice((2, 6, 9)), "hero_seat": rng.choice((1, 2, 2, 3)), "button_seat": rng.randint(1, 6), "bb": 0.02},
        "players": [{"seat": s, "starting_stack": rng.choice((1.0, 2.0, 2.0, round(rng.random() * 3, 2)))} for s in seats],
        "streets": [{"street": s} for s in sorted({a["street"] for a in actions} - {"preflop"})],
        "actions": actions,
        "outcome": {"winners": [str(s) for s in seats if rng.random() < 0.3], "showdown": rng.random() < 0.3},
    }


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(21)
    sizes = [1, 2, 4, 9, 12, 33, 60, 60, 80, 100]
    return [[generated_hand(rng, (2,) if i % 3 == 0 else (2, 3, 5, 6)) for _ in range(n)] for i, n in enumerate(sizes)]


@pytest.fixture(scope="module")
def tables(spark, chunks):
    rows = [(c, i, json.dumps(h)) for c, hs in enumerate(chunks) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "chunk_id long, hand_ix int, j string")
    return long_tables(df.select("chunk_id", "hand_ix", F.from_json("j", HAND_DDL).alias("hand")))


@pytest.mark.parametrize("name", list(plain_features.SETS))
def test_set_is_the_plain_version(tables, chunks, name):
    prefix = REGISTRY[name][0]
    got = {r["chunk_id"]: r.asDict() for r in compute(tables, [name]).collect()}
    wrong = []
    for c, chunk in enumerate(chunks):
        want = plain_features.SETS[name](chunk)
        assert {prefix + k for k in want} == set(got[c]) - {"chunk_id"}
        for k, x in want.items():
            y = got[c][prefix + k]
            if (x is None or y is None) and x != y or x is not None and y is not None and not math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7):
                wrong.append((k, c, x, y))
    assert not wrong, (len(wrong), wrong[:12])


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_plan_of_a_set_is_wide(spark, sf, name):
    """Sorts, windows and groupings of a plan without exchanges hold their buffers in one task, a page each at least."""
    from quillon.functions.sql import PLAN_OPERATORS
    from quillon.plans import catalog

    plan = catalog.QUERIES[f"features_{name}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(op) for op in (" Sort [", " Window [", "HashAggregate(", "ObjectHashAggregate(", "SortAggregate(")) <= 2 * PLAN_OPERATORS


def test_buckets_follow_the_actions(spark):
    from quillon.operators.longform import bucket_count

    assert bucket_count(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 300_000_000 / bucket_count(spark, 300_000_000) <= 500_000
