"""Nearest neighbours with components of any size; mixing with weights of zero and fractions."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillon.llm import ann, mixing


def plain_nearest(qid, q, cid, c, k):
    out = {}
    with np.errstate(all="ignore"):
        for i, v in zip(qid, q, strict=True):
            s = np.cumsum(v * c, axis=1)[:, -1]
            s[np.isnan(s)] = -np.inf
            best = sorted((-x, j) for x, j in zip(s.tolist(), cid.tolist(), strict=True) if j != i)
            out[i] = [(j, -x) for x, j in best[:k]]
    return out


SCALES = {"large": [1e200], "small": [1e-165], "smaller": [1e-170], "denormal": [1e-320], "mixed": [1e200, 1e-165, 1.0, 1e-320, 1e155, 1e-155], "ordinary": [1.0], "largest": [1e308, 1.0]}


@pytest.mark.parametrize("name", SCALES)
@pytest.mark.parametrize("whole", [False, True])
def test_nearest_at_any_scale(name, whole):
    rng = np.random.default_rng(len(name))
    n, dims = 1500, 6
    x = rng.integers(-127, 128, (n, dims)).astype(float) if whole else rng.normal(size=(n, dims))
    x[~x.any(1)] = 1.0
    c = x / (128 if name == "largest" else 1) * rng.choice(SCALES[name], (n, 1))
    c = c[np.isfinite(c).all(1) & c.any(1)]
    cid = np.arange(len(c)) + 1
    qid, q = cid[::97], c[::97]
    got = {i: [(j, v) for v, j in best] for i, best in ann.cell_nearest(qid, q, cid, c, 9)}
    assert got == plain_nearest(qid, q, cid, c, 9)


def test_components_of_very_unlike_size():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(400, 4)) * 10.0 ** rng.integers(-320, 300, (400, 4)).astype(float)
    c = c[c.any(1)]
    cid = np.arange(len(c)) + 1
    got = {i: [(j, v) for v, j in best] for i, best in ann.cell_nearest(cid[:40], c[:40], cid, c, 5)}
    assert got == plain_nearest(cid[:40], c[:40], cid, c, 5)


def test_the_largest_of_all_is_found(spark):
    rows = [(2, [1e200, 1e200]), (20, [1.0, 1.0]), (3, [5.0, 5.0]), (4, [1e-320, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df.where("vec_id = 20"), df, 3).orderBy("rank").collect()]
    assert got == [(1, 2, 2e200), (2, 3, 10.0), (3, 4, 1e-320)]


def test_repeated_candidates_are_dealt_apart_only_if_they_differ(spark):
    rows = [(20, [1.0, 0.0])] + [(7, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r["score"] for r in ann.nearest(df.where("vec_id = 20"), df, 4).orderBy("rank").collect()]
    assert got == [29.0, 28.0, 27.0, 26.0]


WEIGHTS = {
    "zero source": {"source": {"a": 0}},
    "zero language": {"language": {"en": 0, "de": 2.5}},
    "zero domain": {"domain": {"d0": 0, "d1": 0}, "source": {"b": 0.1}},
    "all of a language zero": {"source": {"a": 0, "b": 0, "c": 0, "(none)": 0, "e": 3}},
    "all zero": {"source": {s: 0 for s in ("a", "b", "c", "e", "(none)")}},
    "fractions": {"source": {"a": 0.5, "b": 1.9}, "language": {"fr": 0.001}},
    "small": {"source": {"a": 1e-9}},
}


@pytest.mark.parametrize("name", WEIGHTS)
@pytest.mark.parametrize("share", [0.3, 1.7])
def test_weights_of_zero_and_fractions(spark, name, share):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "c", "e", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, weights=WEIGHTS[name], budget_share=share).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(mixing.oracle_sql(budget_share=share, weights=WEIGHTS[name])).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, want))
    used = defaultdict(int)
    for r in got:
        for level, key in (("domain", "domain"), ("language", "language"), ("source", "source_name")):
            used[level, r[key]] += r["copies"] * r["tokens"] + r["partial_tokens"]
    for level, named in WEIGHTS[name].items():
        assert all(used[level, n] == 0 for n, w in named.items() if w == 0)
    able = [r for r in rows if not any(named.get(v, 1) == 0 for named, v in ((WEIGHTS[name].get("source", {}), r[3] or "(none)"), (WEIGHTS[name].get("language", {}), r[2])))]
    if "domain" not in WEIGHTS[name]:  # what those of weight 0 don't take goes to the others, as far as they can
        total = sum(len(r[1].split()) for r in rows)
        most = 2 * sum(len(r[1].split()) for r in able)
        assert abs(sum(v for (level, _), v in used.items() if level == "domain") - min(most, total * share)) <= 20


def test_weights_are_not_negative():
    with pytest.raises(ValueError, match="0 or more"):
        mixing.whole_weights({"a": -0.5})
    assert mixing.whole_weights({"a": 0.5, "b": 1.9, "c": 0}) == ({"a": 5, "b": 19, "c": 0}, 10)
