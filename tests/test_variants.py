"""VARIANT: seeds that tell missing from null, keys dropped at any depth, metrics without a schema."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import sanitize, variants


def parsed(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string").select("id", "t", F.try_parse_json("t").alias("v"))


def test_seed_text(spark):
    values = {'{"a":null}': "None", "{}": "", '{"a":4}': "4", '{"a":-12}': "-12", '{"a":1.5}': "1.5", '{"a":2.0}': "2.0", '{"a":true}': "True", '{"a":false}': "False", '{"a":"x|y"}': "x|y", '{"a":""}': "", '{"a":"None"}': "None", "[]": "", "no json": ""}
    df = parsed(spark, list(values)).select("id", variants.seed_text(variants.field(F.col("v"), "$.a")).alias("s"))
    assert [r["s"] for r in df.orderBy("id").collect()] == list(values.values())


def test_keys_go_at_any_depth(spark):
    doc = {"label": 1, "a": {"is_bot": True, "b": [{"label": None, "c": [[{"label": {"label": 2}, "d": "é"}]]}, 3, None]}, "labels": 0}
    texts = [json.dumps(doc), "[1, {\"label\": 2}]", "nope", None, "\"label\""]
    got = [r["x"] for r in parsed(spark, texts).orderBy("id").select(variants.drop_keys(F.col("t"), sanitize.PRIVATE).alias("x")).collect()]
    assert got == ['{"a":{"b":[{"c":[[{"d":"é"}]]},3,null]},"labels":0}', "[1,{}]", None, None, '"label"']


def test_metrics_of_any_shape(spark):
    texts = ['{"a":{"b":{"c":2,"ok":true,"no":false}},"l":[1,2,3],"e":[],"s":"t","n":null,"o":{}}', '{"z":1.25}', "[1]", "7", None, "bad"]
    got = sorted(tuple(r) for r in variants.flat_metrics(parsed(spark, texts), ["id"], "v").collect())
    assert got == [(0, "a/b/c", 2.0), (0, "a/b/no", 0.0), (0, "a/b/ok", 1.0), (0, "e_count", 0.0), (0, "l_count", 3.0), (1, "z", 1.25)]


def test_deeper_than_asked_is_an_error(spark):
    df = parsed(spark, ['{"a":{"b":{"c":1}}}'])
    assert variants.flat_metrics(df, ["id"], "v", depth=2).count() == 1
    with pytest.raises(Exception, match="nested deeper"):
        variants.flat_metrics(df, ["id"], "v", depth=1).collect()


def test_no_rows(spark):
    assert variants.flat_metrics(parsed(spark, []), ["id"], "v").count() == 0


def test_the_view_tells_null_from_missing(spark):
    """Seeds of the canonical view by hand: `None` for a null, empty for what isn't there, whatever the fixed schema makes of both."""
    import hashlib

    from quillon.operators.longform import HAND_DDL

    def hand(action, **meta):
        return {"metadata": {"bb": 1.0, "max_seats": 6} | meta, "players": [{"seat": 1}, {"seat": 2}], "actions": [{"street": "flop", "actor_seat": 1, "action_type": "bet", "amount": 2.1, "pot_before": 4.0, "pot_after": 6.1} | action] * 2}

    cases = [hand({"action_id": "7"}, hero_seat=2), hand({"action_id": None}, hero_seat=2), hand({}, hero_seat=2), hand({"action_id": "7"}), hand({"action_id": "7"}, hero_seat=None)]
    df = parsed(spark, [json.dumps(c) for c in cases]).select("id", F.from_json("t", HAND_DDL).alias("hand"), "v")
    got = {r["id"]: r["hand"]["actions"][0]["normalized_amount_bb"] for r in sanitize.canonical(df, raw="v").collect()}
    plain = {r["id"]: r["hand"]["actions"][0]["normalized_amount_bb"] for r in sanitize.canonical(df).collect()}

    def noise(seed):
        return hashlib.sha256(seed.encode()).digest()[1] / 255 * 2 - 1

    want = [round(2.0 + noise(f"{hero}|6|flop|1|{ident}|amount") * 0.22, 2) for hero, ident in (("2", "7"), ("2", "None"), ("2", ""), ("", "7"), ("None", "7"))]
    assert [got[i] for i in range(5)] == pytest.approx(want) and len(set(want)) > 3
    assert plain[1] == plain[2] == got[2] and plain[0] == got[0]


def test_levels_read_their_input_once(spark):
    df = parsed(spark, ['{"a":{"b":1}}']).withColumn("v", F.parse_json(variants.drop_keys(F.col("t"), ["label"])))
    plan = variants.flat_metrics(df, ["id"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
