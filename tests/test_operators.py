"""Operators on fixtures small enough to work out by hand."""

import gzip
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import calibrate, drift, metrics, registry, sanitize, tokens, weights
from quillon.operators.features import compute, set_of
from quillon.operators.longform import HAND_DDL, long_tables
from quillon.sources import hands as sources


def hand(actions, hero=2, seats=(1, 2), bb=0.02, **meta):
    return {
        "metadata": {"max_seats": 6, "hero_seat": hero, "button_seat": 1, "bb": bb} | meta,
        "players": [{"seat": s, "starting_stack": 2.0} for s in seats],
        "streets": [],
        "actions": [{"action_id": str(i + 1), "amount": 0.0, "normalized_amount_bb": 0.0, "pot_before": 0.03, "pot_after": 0.03} | a for i, a in enumerate(actions)],
        "outcome": {"winners": [], "showdown": False},
        "label": "bot",
    }


def frame(spark, chunks):
    rows = [(f"c{c}", i, json.dumps(h)) for c, hs in enumerate(chunks) for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "chunk_id string, hand_ix int, j string")
    return df.select("chunk_id", "hand_ix", F.from_json("j", HAND_DDL).alias("hand"))


def act(street, seat, kind, amount=0.0, before=0.03, **more):
    return {"street": street, "actor_seat": seat, "action_type": kind, "amount": amount, "normalized_amount_bb": amount / 0.02, "pot_before": before, "pot_after": before + amount} | more


def test_preflop_dynamics(spark):
    h = hand([act("preflop", 1, "raise", 0.06, raise_to=0.06), act("preflop", 2, "raise", 0.18, raise_to=0.18), act("preflop", 1, "call", 0.12), act("flop", 1, "check"), act("flop", 2, "bet", 0.2)])
    row = compute(long_tables(frame(spark, [[h]])), ["actions", "temporal", "hero"]).head()
    assert row["threebet_rate"] == 1 and row["fourbet_rate"] == 0 and row["limp_rate"] == 0 and row["cbet_rate"] == 1
    assert row["new_reraise_ratio_mean"] == pytest.approx(3.0)
    assert row["new4_bt_hero_3bet_rate"] == 1 and row["new4_bt_hero_open_raise_rate"] == 0
    assert row["new4_at_preflop_max_depth"] == 2 and row["new4_at_hero_count_at_2bet"] == 1


def test_check_raise_and_limp(spark):
    h = hand([act("preflop", 1, "call", 0.02), act("flop", 2, "check"), act("flop", 1, "bet", 0.05), act("flop", 2, "raise", 0.2)])
    row = compute(long_tables(frame(spark, [[h]])), ["actions", "hero"]).head()
    assert row["limp_rate"] == 1 and row["checkraise_per_hand"] == 1 and math.isnan(row["cbet_rate"] or math.nan)
    assert row["new4_bt_faced_flop_aggression_count"] == 1 and row["new4_gto_raise_vs_bet_rate_flop"] == 1


def test_hands_without_actions_or_players(spark):
    bare = hand([], seats=())
    row = compute(long_tables(frame(spark, [[bare, bare]]))).head()
    assert row["n_hands"] == 2 and row["fold_rate"] == 0 and row["bet_mean_bb"] is None
    assert row["new3_hand_count"] == 2 and row["new3_schema_action_signature_top_share"] == 1
    assert len(row) == 606
    assert set_of("new3_x") == "perhand" and set_of("fold_rate") == "actions"


def test_no_chunks(spark):
    assert compute(long_tables(frame(spark, [])), ["actions", "context"]).count() == 0


def test_runs_test(spark):
    series = [1, 1, 1, 0, 0, 0, 1, 0, 1, 0, 1, 0]
    hs = [hand([act("preflop", 1, "call" if v else "fold", 0.02 * v)], seats=(1,)) for v in series]
    row = compute(long_tables(frame(spark, [hs])), ["temporal"]).head()
    n1 = n0 = 6
    runs, mu = 8, 2 * n1 * n0 / 12 + 1
    var = 2 * n1 * n0 * (2 * n1 * n0 - 12) / (144 * 11)
    assert row["new_vpip_runs_z_mean"] == pytest.approx((runs - mu) / math.sqrt(var))


def view(spark, h):
    return json.loads(sanitize.canonical(frame(spark, [[h]])).select(F.to_json("hand")).head()[0])


def test_view_keeps_hero(spark):
    v = view(spark, hand([act("preflop", 1, "call", 0.02)], max_seats=2))
    assert v["metadata"]["hero_seat"] == 2 and "label" not in v


def test_view_drops_idle_unknowns_and_repeats_a_single_action(spark):
    v = view(spark, hand([act("preflop", 1, "other", before=0.0), act("preflop", 2, "other", 0.1, call_to=0.1)]))
    kinds = [a["action_type"] for a in v["actions"]]
    assert len(kinds) == 12 and set(kinds) == {"call"} and [a["action_id"] for a in v["actions"]] == [str(i) for i in range(1, 13)]


def test_view_drops_blinds_and_names_all_in(spark):
    v = view(spark, hand([act("preflop", 1, "small_blind", 0.01), act("preflop", 2, "big_blind", 0.02), act("preflop", 1, "all_in", 0.16, raise_to=0.16)]))
    kinds = {a["action_type"] for a in v["actions"]}
    assert kinds == {"raise"}


def test_view_samples_ends_and_order(spark):
    v = view(spark, hand([act(s, 1 + i % 3, "bet", 0.1 + i / 50, 0.2 + i / 10) for i, s in enumerate(["preflop"] * 5 + ["flop"] * 5 + ["turn"] * 5)]))
    assert 5 <= len(v["actions"]) <= 8
    assert v["actions"][0]["street"] == "preflop" and v["actions"][-1]["street"] == "turn"


def test_view_without_a_big_blind(spark):
    v = view(spark, hand([act("preflop", 1, "bet", 1.0), act("preflop", 2, "call", 1.0)], bb=0.0))
    assert all(a["amount"] == 0 for a in v["actions"])


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 1), ("g", 2, 0.5, 0), ("g", 3, 0.5, 1), ("g", 4, 0.1, 0)], "g string, ord int, score double, label int")
    ap = metrics.average_precision(df, ["g"]).head()["ap"]
    assert ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    r = metrics.recall_at_fpr(df, ["g"], "ord").head()
    assert (r["recall"], r["fpr"]) == (0.5, 0.0)


@pytest.mark.parametrize("bounded", [False, True])
def test_one_ranking_gives_both_metrics(spark, bounded):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0.1, 0.4, 0.4, 0.7, 0.9]), 1 if g == "ones" else 0 if g == "zeros" else rng.randint(0, 1)) for g in ("a", "b", "ones", "zeros", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, ord int, score double, label int").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in metrics.ranking(df, ["g"], "ord", bounded=bounded).collect()}
    ap = {r["g"]: r["ap"] for r in metrics.average_precision(df, ["g"]).collect()}
    recall = {r["g"]: (r["recall"], r["fpr"]) for r in metrics.recall_at_fpr(df, ["g"], "ord").collect()}
    assert {g: v[0] for g, v in got.items()} == pytest.approx(ap) and {g: v[1:] for g, v in got.items()} == recall


def test_windowed_reward_counts(spark):
    rows = [(7, i, 0.1 if i < 50 else 0.9, int(i >= 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "uid int, ord int, score double, label int")
    df = df.withColumn("cov", F.lit(1.0)).withColumn("lat", F.when(F.col("ord") > 97, 10.0))
    full, short = metrics.windowed_rewards(df, ["uid"], "ord", 100, "cov", "lat").head(), metrics.windowed_rewards(df, ["uid"], "ord", 101).head()
    assert full["sample_count"] == 100 and full["reward"] == pytest.approx(1.0) and (full["coverage_rate"], full["latency_mean_seconds"]) == (1.0, 10.0)
    assert short["reward"] == 0 and short["fpr"] == 1


def test_epoch_calendar(spark):
    golden = {
        "2026-04-28 10:00:00": ("day_2026-04-27_2000utc", "2026-04-27 20:00:00", "2026-04-28 20:00:00"),
        "2026-05-12 21:00:00": ("day_2026-05-12_2000utc", "2026-05-12 20:00:00", "2026-05-15 20:00:00"),
        "2026-05-15 19:59:59": ("day_2026-05-12_2000utc", "2026-05-12 20:00:00", "2026-05-15 20:00:00"),
        "2026-06-17 20:00:00": ("day_2026-06-17_2000utc", "2026-06-17 20:00:00", "2026-06-22 20:00:00"),
        "2026-06-22 19:00:00": ("day_2026-06-17_2000utc", "2026-06-17 20:00:00", "2026-06-22 20:00:00"),
        "2026-06-23 00:00:00": ("day_2026-06-22_2000utc", "2026-06-22 20:00:00", "2026-06-27 00:00:00"),
        "2026-06-27 00:00:00": ("day_2026-06-27_0000utc", "2026-06-27 00:00:00", "2026-07-02 00:00:00"),
    }
    df = spark.createDataFrame([(k,) for k in golden], "t string").select("t", weights.epoch(F.col("t").cast("timestamp")).alias("e"))
    for r in df.select("t", "e.id", F.col("e.start").cast("string").alias("s"), F.col("e.end").cast("string").alias("x")).collect():
        assert (r["id"], r["s"], r["x"]) == golden[r["t"]]


def test_winner_and_weights(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.2), ("b", 1, 0.0)], "g string, uid long, reward double")
    assert {r["g"]: r["winner"] for r in weights.winner(df, ["g"]).collect()} == {"a": 1, "b": 0}
    e = spark.createDataFrame([("a", 1, 2.0, 0), ("a", 2, 1.0, 1), ("a", 3, float("nan"), 2), ("b", 0, 0.5, 0), ("b", 1, 0.7, 1)], "g string, uid int, weight double, pos int")
    got = {(r["g"], r["uid"]): r["weight"] for r in weights.resolve_weights(e, ["g"], 10).collect()}
    assert got == {("a", 1): pytest.approx(2 / 3), ("a", 2): pytest.approx(1 / 3), ("b", 0): 0.5, ("b", 1): 0.7}


def test_rotation_wraps(spark):
    u = spark.createDataFrame([(i,) for i in range(5)], "uid int")
    assert [r["uid"] for r in weights.rotate(u, 2, 3).orderBy("turn").collect()] == [3, 4, 0]


def test_compliance_and_fingerprint(spark):
    good = ("yes", "r/", "abcdef0", "m", "1", "t", "p", ["a.py"], "h")
    rows = [good, ("false", "r", "zz", "m", None, "t", "p", [" ", None], None), ("1", "std/", "ABCDEF0", "m", "1", "t", "p", ["a"], "h"), ("true", "std", None, "std model", "1", "t", "p", ["a"], "h"), (None,) * 9]
    schema = "uid int, at int, open_source string, repo_url string, repo_commit string, model_name string, model_version string, training_data_statement string, private_data_attestation string, implementation_files array<string>, implementation_sha256 string"
    m = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema)
    rows = registry.compliance(m, "uid", "at", "std", "std model").orderBy("at").collect()
    assert [r["status"] for r in rows] == ["transparent"] + ["opaque"] * 4 and [r["status_changed"] for r in rows] == [True, True, False, False, False]
    assert rows[1]["missing"] == ["open_source", "model_version", "implementation_files", "implementation_sha256"] and rows[1]["violations"] == ["repo_commit_invalid"]
    assert rows[2]["missing"] == [] and rows[2]["violations"] == ["repo_commit_invalid", "repo_url_must_point_to_model_repo"]
    assert rows[3]["missing"] == ["repo_commit"] and rows[3]["violations"] == ["repo_commit_invalid"]
    assert rows[4]["missing"] == list(registry.REQUIRED) and rows[4]["violations"] == []
    j = spark.createDataFrame([('{"b": 1, "a": 1e-05}',), ('{"a":0.00001,"b":1}',), ("{broken",)], "j string").select(registry.fingerprint(F.col("j")).alias("f")).collect()
    assert j[0]["f"] == j[1]["f"] and j[2]["f"] is None


def test_constant_features_drift(spark):
    a = spark.createDataFrame([(float(i), 1.0) for i in range(30)], "x double, y double")
    got = {r["feature"]: (r["z"], r["robust"]) for r in drift.out_of_domain(a, a, ["x", "y"]).collect()}
    assert got["x"] == (0.0, True) and got["y"] == (float("inf"), False)
    assert drift.select_features(["p_a", "q_b"], prefixes=("p_",)) == ["p_a"]
    with pytest.raises(ValueError):
        drift.select_features(["a"], allow=["b"])


def test_quantile_map(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    m = calibrate.QuantileMap.fit(df, ["x"])
    q = spark.createDataFrame([(-5.0,), (0.0,), (50.0,), (75.5,), (100.0,), (None,)], "x double").select(m.rank("x").alias("r"), m.normal("x").alias("n")).collect()
    assert [r["r"] for r in q[:5]] == pytest.approx([0, 0, 0.5, 0.755, 1]) and q[5]["r"] is None
    assert q[2]["n"] == pytest.approx(0, abs=1e-6) and q[3]["n"] == pytest.approx(0.6903, abs=1e-3)


def test_tokens(spark):
    t = long_tables(frame(spark, [[hand([act("preflop", 2, "raise", 0.06), act("flop", 1, "check"), act("flop", 2, "bet", 0.09, 0.1)])]]))
    assert tokens.documents(t.hand, t.act).head()["doc"] == "pRo fBl pRo_fBl pos1 len2 nseats2"


def test_sources(spark, tmp_path):
    h = hand([act("preflop", 1, "call", 0.02)])
    (tmp_path / "flat.json").write_text(json.dumps([h] * 5))
    assert sources.flat(spark, str(tmp_path / "flat.json"), 2).count() == 4
    (tmp_path / "dump_2026-01-02_10.json").write_text(json.dumps([[h, h], [h]]))
    d = sources.dumps(spark, str(tmp_path / "dump_2026-01-02_10.json"))
    assert d.groupBy("chunk_id").count().count() == 2 and d.head()["data"] == "2026-01-02"
    rec = {"chunkId": "r", "sourceDate": None, "chunks": [[h], [h, h]], "groundTruth": [1, 0]}
    (tmp_path / "data_2026_03_04.json").write_text(json.dumps({"data": {"chunks": [rec, rec | {"chunkId": "bad", "groundTruth": [1]}]}}))
    r = sources.records(spark, str(tmp_path / "data_2026_03_04.json")).collect()
    assert len(r) == 3 and {x["data"] for x in r} == {"2026-03-04"} and {x["chunk_id"]: x["label"] for x in r} == {"r#0": 1, "r#1": 0}


def test_broken_elements_cost_themselves_only(spark, tmp_path):
    h = hand([act("preflop", 1, "call", 0.02)], game_type='a "quoted" ] } [ { name \\')
    whole, bad = json.dumps(h), '{"metadata": {"bb": }, "players": [1, 2,]}'
    for name, parts in {"start": [bad, whole, whole, whole], "middle": [whole, bad, whole, whole], "end": [whole, whole, whole, bad]}.items():
        (tmp_path / f"{name}.json").write_text("[" + ", ".join(parts) + "]")
        with gzip.open(tmp_path / f"{name}z.json.gz", "wt") as f:
            f.write("[" + ",\n".join(parts) + "]")
        for path in (f"{name}.json", f"{name}z.json.gz"):
            got = sources.flat(spark, str(tmp_path / path), 3).collect()
            assert [r["hand_ix"] for r in got] == [0, 1, 2] and all(r["hand"]["metadata"]["game_type"] == h["metadata"]["game_type"] for r in got)
    (tmp_path / "n.json").write_text(f"[[{whole}], [{whole}, {bad}], [{whole}, {whole}]]")
    assert sources.nested(spark, str(tmp_path / "n.json")).groupBy("chunk_id").count().count() == 2
    rec = json.dumps({"chunkId": "r", "chunks": [[h]], "groundTruth": [1]})
    (tmp_path / "data_2026_01_05.json").write_text('{"data": {"n": {"x": 1}, "chunks": [{"chunkId": }, ' + rec + "]}}")
    assert [(r["chunk_id"], r["data"]) for r in sources.records(spark, str(tmp_path / "data_2026_01_05.json")).collect()] == [("r#0", "2026-01-05")]
    assert sources.flat(spark, str(tmp_path / "n.json"), 1).count() == 0
    (tmp_path / "e.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"a"')
    assert sources.elements(spark, str(tmp_path / "e.json"), "[", "{").count() == sources.elements(spark, str(tmp_path / "cut.json"), "[", "{").count() == 0


def test_files_land_once(spark, tmp_path):
    listed, done = (spark.createDataFrame([(f,) for f in fs], "file string") for fs in (["a", "b", "c"], ["b"]))
    assert sorted(r["file"] for r in sources.new_files(listed, done).collect()) == ["a", "c"]
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "data string, x int")
    sources.land(df, str(tmp_path / "t"), "data")
    assert (tmp_path / "t" / "data=d1").is_dir() and sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("data", "x").collect())) == [("d1", 1), ("d2", 2)]


def test_running_sums_and_quantiles(spark):
    from quillon.functions.ranks import quantiles, running

    rng = random.Random(1)
    rows = [(g, rng.randrange(50) / 4, i) for i in range(400) for g in (None, "a", "b")] + [("one", 2.5, 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(5)
    got = {(r["g"], r["i"]): (r["s"], r["all_s"]) for r in running(df.where("x is not null"), ["g"], [F.desc("x"), F.col("i")], {"s": "x"}).collect()}
    for g in (None, "a", "b", "one"):
        own, total = sorted(((x, i) for k, x, i in rows if k == g), key=lambda t: (-t[0], t[1])), 0.0
        for x, i in own:
            total += x
            assert got[(g, i)] == pytest.approx((total, sum(x for x, _ in own)))
    q = {(r["g"], r["level_ix"]): r["quantile"] for r in quantiles(df, ["g"], "x", [0, 0.1, 0.5, 1]).collect()}
    for g in (None, "a", "b", "one"):
        own = [x for k, x, _ in rows if k == g]
        assert [q[(g, k)] for k in range(4)] == pytest.approx(np.quantile(own, [0, 0.1, 0.5, 1]).tolist())
    assert ("none", 0) not in q


def test_threshold_search_and_bootstrap(spark):
    c = spark.createDataFrame([(0.3, 0.9, 0.2), (0.5, 0.7, 0.1), (0.6, 0.7, 0.05), (0.9, 0.1, 0.0)], "threshold double, objective double, fpr_upper double")
    assert calibrate.search_threshold(c).head()[0] == 0.5
    assert calibrate.search_threshold(c, most=-1.0, fallback=0.42).head()[0] == 0.42
    days = spark.createDataFrame([(d, d, 10) for d in range(7)], "day int, fp long, n long")
    upper, least = (metrics.day_bootstrap(days, "day", "fp", "n", q=q).head()[0] for q in (0.95, 0.0))
    assert 0 <= least < 0.3 < upper <= 0.6
    same = spark.createDataFrame([(d, 1, 4) for d in range(5)], "day int, fp long, n long")
    assert metrics.day_bootstrap(same, "day", "fp", "n").head()[0] == 0.25


def test_numeric_state(spark, tmp_path):
    from quillon.sources import state

    uids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "uid long, hotkey string")
    path = str(tmp_path / "scores")
    assert {r["score"] for r in state.read_scores(spark, path, uids).collect()} == {0.0}
    for step in (3, 4):
        state.write_scores(spark.createDataFrame([(0, step / 2, "a", step), (1, 1.0, "old", step)], state.STATE), path)
    assert sorted(tuple(r) for r in state.read_scores(spark, path, uids).collect()) == [(0, 2.0, "a", 4), (1, 0.0, "b", 4), (2, 0.0, "c", 4)]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    (tmp_path / "broken.json").write_text('{"uid": "x", ')
    assert state.read_or_empty(spark, str(tmp_path / "broken"), state.STATE).count() == 0
    assert state.read_or_empty(spark, str(tmp_path / "broken.json"), state.STATE, "json").count() == 0


def test_a_read_that_fails_resets_no_state(spark, tmp_path, monkeypatch):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from quillon.sources import state

    path = str(tmp_path / "scores")
    state.write_scores(spark.createDataFrame([(0, 2.0, "a", 1)], state.STATE), path)
    uids = spark.createDataFrame([(0, "a")], "uid long, hotkey string")
    (tmp_path / "scores" / "step=1").chmod(0o000)  # no permission to list (root may: then the read works)
    try:
        assert state.read_scores(spark, path, uids).head()["score"] == 2.0
    except Exception as e:
        assert not state.unparsable(e)
    finally:
        (tmp_path / "scores" / "step=1").chmod(0o755)
    gone = next((tmp_path / "scores" / "step=1").glob("*.parquet"))
    found = spark.read.schema(state.STATE).parquet(path)  # listed while the file is there
    gone.rename(tmp_path / "away")
    with pytest.raises((PySparkException, Py4JJavaError)) as lost:
        found.write.format("noop").mode("overwrite").save()
    assert not state.unparsable(lost.value)

    class Reader:
        """A reader whose table fails as one does whose executor is lost."""

        def __getattr__(self, name):
            return lambda *a, **k: found if name == "load" else self

    (tmp_path / "away").rename(gone)
    found.count()
    gone.rename(tmp_path / "away")
    with monkeypatch.context() as m:
        m.setattr(type(spark), "read", property(lambda self: Reader()))
        with pytest.raises((PySparkException, Py4JJavaError)):
            state.read_scores(spark, path, uids)
    (tmp_path / "away").rename(gone)
    assert state.read_scores(spark, path, uids).head()["score"] == 2.0


def test_stream_registry(spark, tmp_path):
    from quillon.streaming.registry import ema_now, ema_stream, served_stream

    for i, keys in enumerate((["a", "a", "b"], ["a"])):
        spark.createDataFrame([(k, i) for k in keys], "fingerprint string, n int").select("fingerprint", F.timestamp_seconds("n").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fingerprint string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = served_stream(stream).writeStream.format("memory").queryName("served").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["fingerprint"]: r["n"] for r in spark.sql("select fingerprint, max(times_served) n from served group by 1").collect()}
    assert got == {"a": 3, "b": 1}
    for rows in ([(1, 0, 0.0), (1, 0, 3.0), (2, 0, 1.0), (3, 2, -1.0)], [(1, 1, 3.0), (1, 4, 2.0), (3, 2, -2.0)], [(1, 2, 5.0), (3, 1, 4.0)]):  # repeats of a step, gaps, late ones
        spark.createDataFrame(rows, "uid long, step long, reward double").coalesce(1).write.mode("append").parquet(str(tmp_path / "rw"))
    s = spark.readStream.schema("uid long, step long, reward double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rw"))
    q = ema_stream(s, 0.5).writeStream.format("memory").queryName("ema").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    batch = {r["uid"]: r["score"] for r in weights.ema(spark.read.parquet(str(tmp_path / "rw")), 0.5).collect()}
    assert {r["uid"]: r["score"] for r in ema_now(spark.table("ema"), 0.5).collect()} == pytest.approx(batch) and len(batch) == 3


def test_stream_epochs_and_cycles(spark, tmp_path):
    from quillon.streaming.registry import epochs, run_cycles

    times = ["2026-01-01 19:59:59", "2026-01-01 20:00:00", "2026-01-02 19:00:00", "2026-01-05 00:00:00"]
    spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    q = epochs(stream, "ts", "1 hour").writeStream.format("memory").queryName("epochs").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["s"]: r["n"] for r in spark.sql("select cast(window.start as string) as s, n from epochs").collect()}
    assert got == {"2025-12-31 20:00:00": 1, "2026-01-01 20:00:00": 2, "2026-01-04 20:00:00": 1}
    seen = []
    for _ in range(2):  # the second run finds nothing new
        run_cycles(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in")), str(tmp_path / "ck2"), lambda df, i: seen.append((i, df.count()))).awaitTermination(60)
    assert seen == [(0, 4)]


def test_stack(spark):
    from quillon.plans.model import Stack, pseudo_labels, time_split

    rows = [(i, float(i % 17), float((i * 7) % 13) if i % 11 else None, int(i % 17 > 8), f"2026-01-{1 + i % 28:02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, day string")
    train, test = time_split(df, "day", "2026-01-20")
    out = Stack(["a", "b"], names=("forest", "linear"), k=3).fit(train, "id").transform(test)
    assert metrics.average_precision(out.withColumn("g", F.lit(1)), ["g"]).head()["ap"] > 0.95
    assert pseudo_labels(out).count() > 0


def test_stack_saves_and_searches(spark, tmp_path):
    from quillon.plans.model import Stack, importances, search

    rows = [(i, float(i % 17), float(i * 7 % 13), int(i % 17 > 8), f"d{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, day string")
    s = Stack(["a", "b"], names=("forest",), meta="mean").fit(df, "id")
    s.save(str(tmp_path / "m"))
    again = Stack.load(spark, str(tmp_path / "m"))
    a, b = (x.transform(df).select("id", "score").orderBy("id").collect() for x in (s, again))
    assert a == b and importances(s, "forest", 1) == ["a"]
    best = search(df, df, ["a", "b"], "id", "day", [0.5, 1.1], [{"names": ("forest",), "meta": "mean"}, {"names": ("linear",), "meta": "mean"}])
    assert best[0][0] == 1.1 and best[0][2] == 2 and len(best) >= 2


def test_stack_calibrates_shifts_weighs_and_refits(spark, tmp_path):
    from quillon.plans.model import Stack, folds, hand_blend, hand_weights

    rows = [(i, float(i % 17) + i % 5 / 3, int(i % 17 > 8), f"c{i % 9 if i % 2 else 0}") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, label int, chunk_id string")
    dealt = folds(df, "id", "label", 4).groupBy("label", "fold").count().collect()
    assert all(max(n) - min(n) <= 1 for n in ([r["count"] for r in dealt if r["label"] == c] for c in (0, 1)))
    w = hand_weights(df)
    assert w.groupBy("chunk_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    plain = Stack(["a"], names=("linear",), meta="mean", k=3).fit(w, "id")
    s = Stack(["a"], names=("linear",), meta="mean", k=3, calibrate=True, threshold=0.3, weight="weight").fit(w, "id")
    out = s.transform(w)
    want = calibrate.logit_shift(calibrate.blended(calibrate.QuantileMap(s.map.levels, {"linear": s.map.quantiles["score"]}), "linear"), 0.3)
    assert out.where(F.abs(F.col("score") - want) > 1e-9).count() == 0 and out.where("score < 0 or score > 1").count() == 0
    assert plain.transform(w).where(F.abs(F.col("score") - F.col("linear")) > 1e-12).count() == 0
    s.save(str(tmp_path / "m"))
    assert Stack.load(spark, str(tmp_path / "m")).transform(w).select("id", "score").orderBy("id").collect() == out.select("id", "score").orderBy("id").collect()
    again = s.refit(w.where("id < 200"), w.where("id >= 200"), "id").transform(w)
    assert [r[0] for r in again.orderBy("id").select("score").collect()] == pytest.approx([r[0] for r in out.orderBy("id").select("score").collect()], abs=1e-6)
    assert spark.createDataFrame([(0.5, 1.0)], "gbt double, linear double").select(hand_blend().alias("x")).head()[0] == pytest.approx(0.7)


def test_state_tables(spark, tmp_path):
    from quillon.sources import state

    assert state.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    df = spark.createDataFrame([("x", 0.5, 1)], "feature string, auc double, ks int")
    state.write_csv(df, str(tmp_path / "c"))
    assert state.read_csv(spark, str(tmp_path / "c"), "feature string, auc double, ks int").collect() == df.collect()
    state.write_summary(df, str(tmp_path / "s"))
    assert "".join(f.read_text() for f in (tmp_path / "s").glob("part*")).startswith('{"auc"')
    nested = spark.sql("select struct(1 as a, true as b, array('x','y') as c) as m, 2.5D as d")
    assert nested.select(*state.flatten_metrics(nested.schema)).head().asDict() == {"m/a": 1, "m/b": 1, "m/c_count": 2, "d": 2.5}
    b = spark.createDataFrame([(0, [("h1",), ("h2",)], True, None), (1, [], False, None), (2, [("h3",)], None, ["r1"]), (3, None, False, None)], "pos int, hands array<struct<hand_id:string>>, is_bot boolean, ref_ids array<string>")
    kept, ids = state.cycle_batches(b)
    assert {r["pos"]: r["is_human"] for r in kept.collect()} == {0: False, 2: True} and sorted(r[0] for r in ids.collect()) == ["h1", "h2", "r1"]


def test_manifest_and_window_objective(spark):
    m = spark.createDataFrame([({"a": " Yes ", "b": None, "c": "  ", "d": "x"},)], "m map<string,string>").select(registry.normalise_manifest(F.col("m")).alias("m")).head()["m"]
    assert m == {"a": "true", "d": "x"}
    j = spark.createDataFrame([('{"a": [" x", null, "", 3], "b": "  ", "n": 2, "open_source": " On ", "e": []}',), ('{"n": 2,"open_source":true,"a":["x","3"]}',)], "j string")
    j = j.select(registry.plain_manifest("j").alias("p"), registry.manifest_digest(F.col("j")).alias("d"), registry.content_hash(F.col("j")).alias("c")).collect()
    assert j[0]["p"] == '{"a":["x","3"],"n":2,"open_source":true}' and j[0]["d"] == j[1]["d"]
    assert j[1]["c"] == hashlib.md5(json.dumps({"n": 2, "open_source": True, "a": ["x", "3"]}, sort_keys=True).encode()).hexdigest()
    df = spark.createDataFrame([(i, 0.1 + (i % 10) / 100 + 0.7 * (i % 2), i % 2) for i in range(200)], "ord int, score double, label int")
    got = {r["fraction"]: r["objective"] for r in metrics.window_objective(df, [0.2, 0.5], windows=5).collect()}
    assert got == pytest.approx({0.2: 1.0, 0.5: 1.0})
    mixed = df.withColumn("score", F.pmod(F.col("ord") * 37, F.lit(101)) / 101.0)
    one, other = (metrics.window_objective(d, [0.3], windows=5).head()["objective"] for d in (mixed, mixed.repartition(7)))
    assert one == other


def test_eligible_takes_targets_as_a_table(spark):
    n = spark.createDataFrame([(u, False, 0.0, "1.2.3.4", 80) for u in range(6)], "uid long, permit boolean, stake double, ip string, port int")
    targets = spark.createDataFrame([(0,), (2,), (2,), (5,), (9,)], "uid long")
    assert sorted(r["uid"] for r in weights.eligible(n, targets).collect()) == [2, 5]
    assert weights.eligible(n, targets.where("false")).count() == 0


def test_stack_query_tells_good_from_bad(spark, sf):
    from quillon.plans.catalog import QUERIES

    got = QUERIES["stack_model"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").isEmpty()
    mean = {r["quality"]: r["m"] for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] > mean[0] + 0.1
