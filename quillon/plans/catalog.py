"""Named queries over the driver tables, each with SQL of its own for the same result.

Rates and scores are rounded to six places on both sides, counts are BIGINT.
Feature sets run over the binding of `events` (bindings.py); ranking metrics
over documents with labels; registries and weights over events and orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.ranks import running
from quillon.functions.sql import DUCK, SPARK, Flow
from quillon.operators import calibrate, drift, metrics, registry, sanitize, tokens, weights
from quillon.operators.features import REGISTRY
from quillon.operators.features import run as run_set
from quillon.operators.longform import HandTables, bucket_count
from quillon.plans import bindings
from quillon.session import bucketed, materialised, new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Query name: feature set and the columns it returns (all of the set, if none are named).
FEATURE_QUERIES: dict[str, tuple[str, tuple[str, ...]]] = {
    **{f"features_{name}": (name, ()) for name in REGISTRY},
    "action_shares": ("actions", ("n_hands", "fold_rate", "call_rate", "raise_rate", "check_rate", "allin_rate")),
    "hand_shape": ("actions", ("avg_streets", "avg_players", "preflop_only_rate", "river_rate", "showdown_rate", "actions_per_hand_mean", "actions_per_hand_std")),
    "size_moments": ("actions", ("bet_mean_bb", "bet_std_bb", "pot_pct_mean", "pot_pct_std", "bet_max_bb")),
    "size_percentiles": ("actions", ("pot_pct_p10", "pot_pct_p90", "pot_pct_p90_p10", "bet_median_bb", "bet_p10_bb", "bet_p90_bb", "bet_iqr_bb")),
    "size_cv": ("actions", ("bet_cv", "pot_pct_cv", "bet_mean_bb_street_cv", "agg_freq_street_cv")),
    "bucket_entropy": ("actions", ("bet_entropy", "bet_bb_entropy", "bet_decimal_entropy", "n_distinct_pot_pcts")),
    "topk_concentration": ("actions", ("bet_mode_concentration", "bet_top3_concentration")),
    "near_target_rate": ("actions", ("round_frac_rate", "near_integer_bb_rate", "common_bb_rate", "near_half_bb_rate", "mean_distance_to_int_bb", "median_distance_to_int_bb")),
    "seat_spread": ("actions", ("seat_betsize_cv_mean", "seat_betsize_cv_min", "seat_pot_pct_range", "seat_pot_pct_std_of_mean", "seat_bet_mean_bb_range", "seat_bet_bb_cv_mean")),
    "seat_styles": ("actions", ("vpip_mean", "vpip_std", "pfr_mean", "pfr_std", "fold_mean", "fold_std")),
    "street_aggression": ("actions", ("agg_freq_preflop", "agg_freq_flop", "agg_freq_turn", "agg_freq_river")),
    "window_cv": ("actions", ("fold_cv_time", "vpip_cv_time")),
    "raise_counts": ("actions", ("threebet_rate", "fourbet_rate")),
    "first_before_flag": ("actions", ("limp_rate",)),
    "last_raiser_first_bet": ("actions", ("cbet_rate",)),
    "check_then_raise": ("actions", ("checkraise_per_hand",)),
    "ngram_entropy": ("temporal", ("action_unigram_entropy", "action_bigram_entropy", "bigram_top1_share", "bigram_top3_share")),
    "cond_entropy": ("temporal", ("action_cond_entropy",)),
    "repeat_rate": ("temporal", ("action_repeat_rate",)),
    "order_slope": ("temporal", ("fold_pos_slope", "fold_rate_first_to_act", "raise_rate_first_to_act", "first_action_fold_share")),
    "lag1_autocorr": ("temporal", ("agg_lag1_autocorr", "vpip_lag1_autocorr")),
    "halves_diff": ("temporal", ("agg_halves_absdiff",)),
    "runs_z": ("temporal", ("vpip_runs_z_mean", "vpip_runs_absz_mean")),
    "dispersion_ratio": ("temporal", ("vpip_dispersion_ratio",)),
    "ratio_chain": ("temporal", ("reraise_ratio_mean", "reraise_ratio_std", "reraise_ratio_cv", "flop_vs_pf_ratio_mean", "flop_vs_pf_ratio_cv", "near_cap_raise_rate")),
    "delta_stats": ("temporal", ("stack_at_cap_rate", "stack_delta_abs_mean", "stack_delta_std", "stack_delta_zero_rate", "stack_topup_rate", "stack_gain_rate", "stack_unique_ratio")),
    "set_jaccard": ("temporal", ("seat_jaccard_mean", "seat_jaccard_min", "table_size_change_rate")),
    "mode_share": ("temporal", ("hero_seat_entropy", "hero_seat_mode_share")),
    "walk_rate": ("temporal", ("walk_rate", "one_action_hand_rate", "hand_len_entropy")),
    "context_entropy": ("context", ("gto_ctx_entropy_mean", "gto_ctx_entropy_std", "gto_ctx_dominance_mean", "gto_ctx_dominance_std", "gto_n_contexts")),
    "monotonicity": ("context", ("pos_agg_monotonicity", "pos_vpip_monotonicity", "pos_agg_range", "pos_vpip_range")),
    "roughness": ("context", ("pos_agg_roughness",)),
    "gini": ("context", ("action_type_gini", "action_type_entropy")),
    "street_shape": ("context", ("street_agg_slope", "street_agg_dropoff")),
    "hu_mw_diff": ("context", ("fold_hu_vs_mw_diff",)),
    "perhand_7stat": ("perhand", tuple(f"schema_action_entropy_{s}" for s in ("mean", "std", "min", "max", "q10", "q50", "q90"))),
    "switch_rate": ("perhand", ("schema_actor_switch_rate_mean", "schema_unique_actor_share_mean")),
    "longest_run": ("perhand", ("schema_actor_run_max_share_mean", "schema_action_run_max_share_mean")),
    "signature_share": ("perhand", tuple(f"schema_{s}_signature_{k}_share" for s in ("action", "actor", "street", "amount_bucket") for k in ("top", "unique"))),
    "fold_to_agg": ("hero", tuple(f"bt_fold_to_{s}_aggression" for s in ("preflop", "flop", "turn", "river"))),
    "aggression_factor": ("hero", ("bt_hero_af_postflop", "bt_hero_af_mismatch", "bt_hero_af_ratio")),
    "open_vs_3bet": ("hero", ("bt_hero_vpip", "bt_hero_3bet_rate", "bt_hero_open_raise_rate", "bt_hero_3bet_vpip_ratio", "bt_hero_3bet_open_ratio")),
    "drift_halves": ("hero", tuple(f"gto_drift_{k}" for k in ("vpip", "pfr", "agg", "fold", "bet_size", "composite", "vpip_signed", "agg_signed"))),
    "next_action_response": ("hero", tuple(f"gto_{k}_{s}" for s in ("preflop", "flop", "turn", "river") for k in ("response_entropy", "fold_rate_vs_bet", "call_rate_vs_bet", "raise_rate_vs_bet"))),
    "probe_rate": ("hero", tuple(f"gto_{k}_{s}" for s in ("flop", "turn", "river") for k in ("probe_rate", "raise_vs_bet_rate", "checked_to_count"))),
    "villain_answers": ("hero", ("at_villain_fold_to_hero_bet", "at_villain_call_to_hero_bet", "at_villain_raise_to_hero_bet", "at_hero_bets_faced_by_villain")),
    "raise_depth": ("hero", ("at_preflop_2bet_rate", "at_preflop_3bet_rate", "at_preflop_4bet_rate", "at_preflop_5bet_plus_rate", "at_preflop_max_depth", "at_preflop_depth_entropy")),
    "spr_bucket": ("hero", ("at_hero_agg_shallow", "at_hero_agg_medium", "at_hero_agg_deep", "at_spr_agg_variance", "at_spr_agg_range")),
    "position_diff": ("hero", ("at_hero_ip_postflop_agg", "at_hero_oop_postflop_agg", "at_hero_ip_oop_agg_diff", "at_hero_ip_ratio")),
}


_BOUND: dict[tuple[str, str], HandTables] = {}


def hands(spark: SparkSession, sf_dir: str) -> HandTables:
    """The binding of `events` as tables, written once for each session and folder: feature sets read them many times."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _BOUND:
        _BOUND[key] = _bind(spark, sf_dir)
    return _BOUND[key]


def _bind(spark: SparkSession, sf_dir: str) -> HandTables:
    """Events are dealt into buckets of their chunk first, the only time that rows move: all that is made of them is within a chunk."""
    events = table(spark, sf_dir, "events")
    n = bucket_count(spark, events.count())  # each event is an action, but for those without a user or a time
    steps = bindings.events_as_hands()
    one = lambda name, steps, **t: bucketed(Flow(last=f"SELECT * FROM {name}").frame(spark, steps, **t), "chunk_id", n)
    ev, act = (1 + [n for n, _ in steps].index(name) for name in ("ev", "act"))
    acts = one("act", steps[ev:act], ev=one("ev", steps[:ev], events=events))
    return HandTables(one("hand", steps[act:], act=acts), one("play", steps[act:], act=acts), acts, n)


def _feature(name: str, only: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_set(REGISTRY[name][1](SPARK, 6, only), hands(spark, sf_dir))

    return run


for _name, (_set, _only) in FEATURE_QUERIES.items():
    QUERIES[_name] = _feature(_set, _only)
    ORACLES[_name] = REGISTRY[_set][1](DUCK, 6, _only).text(bindings.events_as_hands())


def query(sql: str | None = None) -> Callable:
    """Registers a function under its own name, with SQL if it has any."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_HANDS = "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in bindings.events_as_hands())
_SCORED = """WITH scored AS (SELECT d.doc_id AS ord, d.lang AS uid, CAST(d.doc_id % 7 AS BIGINT) AS day, CAST(d.n_chars % 997 AS DOUBLE) / 997 AS score, CAST(l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL)"""
_AP = """, ap_s AS (SELECT {by}, score, CAST(sum(label) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY {by}, score),
  ap_c AS (SELECT {by}, tp / nullif(sum(tp) OVER (PARTITION BY {by}), 0) * (sum(tp) OVER w / sum(n) OVER w) AS part FROM ap_s WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
  ap AS (SELECT {by}, coalesce(sum(part), 0) AS ap FROM ap_c GROUP BY {by}),
  rk_c AS (SELECT {by}, CAST(sum(label) OVER w AS DOUBLE) / nullif(sum(label) OVER (PARTITION BY {by}), 0) AS recall, CAST(sum(1 - label) OVER w AS DOUBLE) / nullif(sum(1 - label) OVER (PARTITION BY {by}), 0) AS fpr
    FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, ord)),
  rk_b AS (SELECT {by}, max(recall) AS recall FROM rk_c WHERE fpr <= 0.05 GROUP BY {by}),
  rk AS (SELECT a.{by}, coalesce(max(b.recall), 0) AS recall, coalesce(min(c.fpr), 0) AS fpr FROM (SELECT DISTINCT {by} FROM {src}) a LEFT JOIN rk_b b ON b.{by} = a.{by} LEFT JOIN rk_c c ON c.{by} = a.{by} AND c.recall = b.recall AND c.fpr <= 0.05 GROUP BY a.{by})"""
_TM = """, tm_c AS (SELECT {by}, sum(label) AS p, sum(1 - label) AS n, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, avg(CAST(score >= 0.5 AS INT)) AS positive_rate FROM {src} GROUP BY {by}),
  tm AS (SELECT {by}, coalesce(CAST(tp AS DOUBLE) / nullif(p, 0), 0) AS hard_recall, coalesce(CAST(fp AS DOUBLE) / nullif(n, 0), 0) AS hard_fpr, positive_rate,
    CASE WHEN p = 0 OR n = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 WHEN CAST(fp AS DOUBLE) / n <= 0.10 THEN 1.0 ELSE greatest(0.0, 1.0 - (CAST(fp AS DOUBLE) / n - 0.10) / 0.90) END AS sanity FROM tm_c)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, uid, day, score, label: documents with labels as scored rows."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.select("doc_id", "lang", "n_chars").join(lab.where("quality is not null").select("doc_id", "quality"), "doc_id")
    return joined.select(F.col("doc_id").alias("ord"), F.col("lang").alias("uid"), (F.col("doc_id") % 7).cast("long").alias("day"), ((F.col("n_chars") % 997).cast("double") / 997).alias("score"), F.col("quality").cast("int").alias("label"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Columns rounded to six places, without a negative zero."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})


def _round(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0 AS {n}" for n in names)


# Ranking and thresholds


@query(_SCORED + _AP.format(by="uid", src="scored") + " SELECT ap.uid, " + _round("ap", "recall", "fpr") + " FROM ap JOIN rk ON rk.uid = ap.uid")
def ap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.ranking(scored(spark, sf_dir), ["uid"], "ord"), "ap", "recall", "fpr")


@query(_SCORED + _TM.format(by="uid", src="scored") + " SELECT uid, " + _round("hard_recall", "hard_fpr", "positive_rate", "sanity") + " FROM tm")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.threshold_metrics(scored(spark, sf_dir), ["uid"]), "hard_recall", "hard_fpr", "positive_rate", "sanity")


_V2 = "CASE WHEN sanity <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.35 * ap + 0.30 * recall + 0.20 * sanity + 0.10 * sanity + 0.05)) END"
_DAILY = _SCORED + _AP.format(by="day", src="scored") + _TM.format(by="day", src="scored") + f", daily AS (SELECT ap.day, ap, recall, fpr, sanity, 0.75 * ap + 0.25 * recall AS reward_v1, {_V2} AS reward_v2 FROM ap JOIN rk ON rk.day = ap.day JOIN tm ON tm.day = ap.day)"


@query(_DAILY + " SELECT day, " + _round("ap", "recall", "fpr", "sanity", "reward_v1", "reward_v2") + " FROM daily")
def daily_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.rewards(scored(spark, sf_dir), ["day"], "ord")
    return r6(m.select("day", "ap", "recall", "fpr", "sanity", "reward_v1", "reward_v2"), "ap", "recall", "fpr", "sanity", "reward_v1", "reward_v2")


@query(_DAILY + ", s AS (SELECT avg(reward_v2) AS mean_daily, stddev_samp(reward_v2) AS std_daily, avg(reward_v2) - 0.5 * stddev_samp(reward_v2) AS sel_score FROM daily) SELECT " + _round("mean_daily", "std_daily", "sel_score") + " FROM s")
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.stability(metrics.rewards(scored(spark, sf_dir), ["day"], "ord")), "mean_daily", "std_daily", "sel_score")


@query(_SCORED + " SELECT uid, round(least(avg(CAST(score < 0.2 AS INT)), avg(CAST(score > 0.8 AS INT))), 6) AS balance FROM scored GROUP BY uid")
def score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.balance(scored(spark, sf_dir), ["uid"]), "balance")


RATES = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(
    _SCORED
    + f""", r AS (SELECT unnest({RATES}) AS rate), c AS (SELECT rate, (SELECT quantile_cont(score, 1 - 0.0) FROM scored) AS top FROM r),
  q AS (SELECT CAST(rate AS DOUBLE) AS rate, CASE rate {' '.join(f'WHEN {x} THEN (SELECT quantile_cont(score, {1 - x}) FROM scored)' for x in RATES)} END AS threshold FROM r),
  n AS (SELECT rate, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS n_tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE label = 0) AS n FROM scored, q GROUP BY rate, threshold),
  m AS (SELECT *, coalesce(CAST(fp AS DOUBLE) / nullif(n, 0), 0) AS fpr FROM n)
  SELECT rate, round(threshold, 6) AS threshold, n_tp, round(fpr, 6) AS fpr, round(CASE WHEN n_tp = 0 THEN 0.0 WHEN fpr <= 0.10 THEN 1.0 ELSE greatest(0.0, 1.0 - (fpr - 0.10) / 0.90) END, 6) AS sanity, fpr <= 0.10 AS safe FROM m"""
)
def threshold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.threshold_scan(scored(spark, sf_dir), RATES), "threshold", "fpr", "sanity")


_N = 40


@query(
    _SCORED
    + f", k AS (SELECT uid, count(*) AS c FROM scored GROUP BY uid), recent AS (SELECT s.* FROM scored s QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ord DESC) <= {_N})"
    + _AP.format(by="uid", src="recent")
    + ", v AS (SELECT uid, avg(CASE WHEN ord % 5 = 0 THEN 0.0 ELSE 1.0 END) AS cov, avg(CASE WHEN ord % 4 <> 0 THEN CAST(ord % 9 AS DOUBLE) END) AS lat FROM recent GROUP BY uid)"
    + f" SELECT ap.uid, least(k.c, {_N}) AS sample_count, round(CASE WHEN k.c >= {_N} THEN ap ELSE 0 END, 6) AS ap, round(CASE WHEN k.c >= {_N} THEN recall ELSE 0 END, 6) AS recall, round(CASE WHEN k.c >= {_N} THEN fpr ELSE 1 END, 6) AS fpr, round(CASE WHEN k.c >= {_N} THEN 0.75 * ap + 0.25 * recall ELSE 0 END, 6) AS reward, round(CAST(cov AS DOUBLE), 6) AS coverage_rate, round(lat, 6) AS latency_mean_seconds FROM ap JOIN rk ON rk.uid = ap.uid JOIN k ON k.uid = ap.uid JOIN v ON v.uid = ap.uid"
)
def windowed_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    s = s.withColumn("cov", F.when(F.col("ord") % 5 == 0, 0.0).otherwise(1.0)).withColumn("lat", F.when(F.col("ord") % 4 != 0, (F.col("ord") % 9).cast("double")))
    m = metrics.windowed_rewards(s, ["uid"], "ord", _N, "cov", "lat")
    return r6(m, "ap", "recall", "fpr", "reward", "coverage_rate", "latency_mean_seconds")


@query("SELECT o.o_custkey AS uid, count(*) AS n_sent, CAST(sum(CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS n_scores, CASE WHEN sum(CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END) = count(*) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM orders o GROUP BY o.o_custkey")
def response_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), "o_orderstatus")
    return metrics.valid_responses(o, o.where("o_orderstatus <> 'P'"), ["uid"])


@query(_SCORED + " SELECT label, CAST(least(39, floor(score * 40)) AS INTEGER) AS bin, count(*) AS n FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(scored(spark, sf_dir), "score", ["label"])


@query(
    _SCORED
    + """, b AS (SELECT label, least(1999, floor(score * 2000)) AS bin, count(*) AS n FROM scored GROUP BY ALL),
  s AS (SELECT label, count(*) AS m, stddev_samp(score) * power(count(*), -0.2) AS h FROM scored GROUP BY label HAVING stddev_samp(score) > 0),
  g AS (SELECT CAST(i AS DOUBLE) / 49 AS x FROM range(50) t(i))
  SELECT b.label, round(g.x, 6) AS x, round(sum(n * exp(-0.5 * power((g.x - (bin + 0.5) / 2000) / h, 2)) / (h * sqrt(2 * 3.141592653589793))) / max(m), 6) AS density FROM b JOIN s ON s.label = b.label, g GROUP BY b.label, g.x"""
)
def score_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.density(scored(spark, sf_dir), "score", ["label"], grid=50), "x", "density")


@query(_DAILY + " SELECT round(min(reward_v2), 6) AS reward_min, round(max(reward_v2), 6) AS reward_max, round(avg(reward_v2), 6) AS reward_mean, count(*) FILTER (WHERE reward_v2 <> 0) AS reward_nonzero, round(avg(ap), 6) AS ap_mean, round(avg(fpr), 6) AS fpr_mean FROM daily")
def reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.reward_summary(metrics.rewards(scored(spark, sf_dir), ["day"], "ord"), "reward_v2", ["ap", "fpr"])
    return r6(m, "reward_min", "reward_max", "reward_mean", "ap_mean", "fpr_mean")


_DRAW = "CAST('0x' || substring(md5({}), 1, 15) AS BIGINT)"


@query(
    _SCORED
    + f""", days AS (SELECT day, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE label = 0) AS n, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM scored GROUP BY day),
  p AS (SELECT DISTINCT d.range AS draw, {_DRAW.format("'0:' || d.range || ':' || k.range")} % (SELECT max(c) FROM days) AS i FROM range(300) d, range(1, (SELECT max(c) + 1 FROM days)) k),
  r AS (SELECT draw, coalesce(CAST(sum(fp) AS DOUBLE) / nullif(sum(n), 0), 0) AS fpr FROM p JOIN days USING (i) GROUP BY draw)
  SELECT round(quantile_cont(fpr, 0.95), 6) AS fpr_upper FROM r"""
)
def release_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = scored(spark, sf_dir).groupBy("day").agg(F.count_if((F.col("score") >= 0.5) & (F.col("label") == 0)).alias("fp"), F.count_if(F.col("label") == 0).alias("n"))
    return r6(metrics.day_bootstrap(days, "day", "fp", "n"), "fpr_upper")


_FRACTIONS, _WINDOWS, _SIZE = (0.2, 0.35, 0.5), 66, 40


@query(
    _SCORED
    + f""", num AS (SELECT score, label, row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format("'0:' || ord")}, ord) - 1 AS place, count(*) OVER (PARTITION BY label) AS total FROM scored),
  fr AS (SELECT unnest(range({len(_FRACTIONS)})) AS k, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in _FRACTIONS)}]) AS fraction, unnest({[round(_SIZE * f) for f in _FRACTIONS]}) AS pos),
  asks AS (SELECT k, fraction, w.range AS w, i.range AS ord, CASE WHEN i.range < pos THEN 1 ELSE 0 END AS label, k * 1000 + w.range AS g FROM fr, range({_WINDOWS}) w, range({_SIZE}) i),
  win AS (SELECT a.g, a.fraction, a.ord, n.score, n.label FROM asks a JOIN (SELECT label, max(total) AS total FROM num GROUP BY label) t ON t.label = a.label
    JOIN num n ON n.label = a.label AND n.place = {_DRAW.format("'0:' || a.k || ':' || a.w || ':' || a.ord")} % t.total)"""
    + _AP.format(by="g", src="win")
    + _TM.format(by="g", src="win")
    + f", v AS (SELECT w.fraction, {_V2} AS reward FROM (SELECT DISTINCT g, fraction FROM win) w JOIN ap ON ap.g = w.g JOIN rk ON rk.g = w.g JOIN tm ON tm.g = w.g) SELECT fraction, round(avg(reward) - 3.0 * avg(CAST(reward = 0 AS INT)), 6) AS objective FROM v GROUP BY fraction"
)
def window_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.window_objective(scored(spark, sf_dir), list(_FRACTIONS), "ord", _WINDOWS, _SIZE), "objective")


# Drift, selection, calibration


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _long(src: str, cond: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {src} WHERE {cond}" for c in _COLS)


@query(
    f"""WITH a AS (SELECT feature, count(x) AS na, avg(x) AS ma, stddev_samp(x) AS sa FROM ({_long('lineitem', "l_returnflag <> 'R'")}) GROUP BY feature),
  b AS (SELECT feature, count(x) AS nb, avg(x) AS mb FROM ({_long('lineitem', "l_returnflag = 'R'")}) GROUP BY feature),
  z AS (SELECT feature, CASE WHEN na < 20 OR nb < 20 THEN NULL WHEN sa < 1e-9 THEN CAST('inf' AS DOUBLE) ELSE abs(mb - ma) / sa END AS z FROM a JOIN b USING (feature))
  SELECT feature, round(z, 6) AS z, coalesce(z <= 5, FALSE) AS robust FROM z"""
)
def ood_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return r6(drift.out_of_domain(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), list(_COLS)), "z")


RULES = [(1, "exact", "click", "plain click"), (2, "substring", "ur", "money"), (3, "substring", "error", "failure")]


@query(
    "WITH rules(rank, kind, pattern, reason) AS (VALUES " + ", ".join(map(str, RULES)) + """), n AS (SELECT DISTINCT event_type AS feature FROM events)
  SELECT n.feature, min_by(r.reason, r.rank) AS reason FROM n LEFT JOIN rules r ON CASE WHEN r.kind = 'exact' THEN lower(n.feature) = lower(r.pattern) ELSE contains(lower(n.feature), lower(r.pattern)) END GROUP BY n.feature"""
)
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("feature")).distinct()
    return drift.rule_filter(names, spark.createDataFrame(RULES, "rank int, kind string, pattern string, reason string"))


@query(
    f"""WITH s AS (SELECT feature, x, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n
    FROM ({" UNION ALL ".join(f"SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in _COLS)}) WHERE x IS NOT NULL GROUP BY feature, x),
  r AS (SELECT feature, p * (sum(n) OVER w - n / 2) AS u, sum(p) OVER a AS tp, sum(n) OVER a AS tn, abs(sum(p) OVER w / nullif(sum(p) OVER a, 0) - sum(n) OVER w / nullif(sum(n) OVER a, 0)) AS gap
    FROM s WINDOW w AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature))
  SELECT feature, round(sum(u) / nullif(max(tp) * max(tn), 0), 6) AS auc, round(max(gap), 6) AS ks FROM r GROUP BY feature"""
)
def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return r6(drift.screen(li, list(_COLS)), "auc", "ks")


@query("WITH m AS (SELECT quantile_cont(CASE WHEN value < 100 THEN value END, 0.5) AS m FROM events) SELECT event_id, round(coalesce(CASE WHEN value < 100 THEN value END, m), 6) AS value FROM events, m")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 100, F.col("value")).alias("value"))
    return r6(drift.impute(e, drift.medians(e, ["value"]), ["value"]), "value")


@query(_SCORED + ", p AS (SELECT ord, least(greatest(score, 1e-6), 1 - 1e-6) AS q FROM scored) SELECT ord, round(1 / (1 + exp(-least(greatest(2.0 * (ln(q / (1 - q)) - ln(0.3 / 0.7)), -40), 40))), 6) AS score FROM p")
def logit_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(scored(spark, sf_dir).select("ord", calibrate.logit_shift(F.col("score"), 0.3, 2.0).alias("score")), "score")


@query(_SCORED + " SELECT ord, round(least(greatest(coalesce(CASE WHEN ord % 10 <> 0 THEN score * 1.5 - 0.2 END, 0.5), 0), 1), 6) AS score FROM scored")
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("ord", calibrate.score_contract(F.when(F.col("ord") % 10 != 0, F.col("score") * 1.5 - 0.2)).alias("score"))


@query()
def quantile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    m = calibrate.QuantileMap.fit(s, ["score"])
    return s.select("ord", m.rank("score").alias("rank"), m.normal("score").alias("normal"), calibrate.blended(m, "score").alias("blended"))


# Cycles: events as rewards of users by day


_REW = "WITH rew AS (SELECT user_id AS uid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100000 AS reward FROM events GROUP BY ALL)"


def daily_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, step (day), reward."""
    e = table(spark, sf_dir, "events")
    step = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return e.groupBy(F.col("user_id").alias("uid"), step.alias("step")).agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100000).alias("reward"))


@query(_REW + " SELECT uid, round(sum(0.05 * power(0.95, (SELECT max(step) FROM rew) - step) * reward), 6) AS score FROM rew GROUP BY uid")
def ema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(weights.ema(daily_rewards(spark, sf_dir)), "score")


@query(
    _REW
    + """, k AS (SELECT *, uid * 10 + CASE WHEN step >= uid % 30 THEN 1 ELSE 0 END AS hotkey FROM rew), c AS (SELECT *, CASE WHEN lag(hotkey) OVER (PARTITION BY uid ORDER BY step) <> hotkey THEN 1 ELSE 0 END AS ch FROM k),
  e AS (SELECT *, sum(ch) OVER (PARTITION BY uid ORDER BY step) AS era FROM c), m AS (SELECT *, max(era) OVER (PARTITION BY uid) AS now FROM e)
  SELECT uid, round(sum(CASE WHEN era = now THEN 0.05 * power(0.95, (SELECT max(step) FROM rew) - step) * reward ELSE 0 END), 6) AS score FROM m GROUP BY uid"""
)
def turnover_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_rewards(spark, sf_dir).withColumn("hotkey", F.col("uid") * 10 + (F.col("step") >= F.col("uid") % 30).cast("int"))
    return r6(weights.ema_since_turnover(r), "score")


@query(_REW + ", b AS (SELECT step, uid, reward - 0.1 AS r, row_number() OVER (PARTITION BY step ORDER BY reward - 0.1 DESC, uid) AS n FROM rew) SELECT step, CAST(CASE WHEN r > 0 THEN uid ELSE 0 END AS BIGINT) AS winner FROM b WHERE n = 1")
def winner_take_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.winner(daily_rewards(spark, sf_dir).withColumn("reward", F.col("reward") - 0.1), ["step"])


@query(_REW + ", w AS (SELECT step, uid, reward, sum(greatest(reward, 0)) OVER (PARTITION BY step) AS t FROM rew) SELECT step, uid, round(coalesce(reward / nullif(t, 0), 0), 6) AS share, CAST(floor(round(coalesce(reward / nullif(t, 0), 0), 9) * 65535) AS INTEGER) AS q FROM w")
def weight_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights.quantise(daily_rewards(spark, sf_dir), ["step"], "reward")
    return r6(w.select("step", "uid", "share", F.floor(F.round("share", 9) * weights.QUANTUM).cast("int").alias("q")), "share")


@query(
    _REW
    + """, v AS (SELECT step, uid % 40 AS uid, CASE WHEN uid % 9 = 0 THEN -reward ELSE reward END AS weight, uid AS pos FROM rew), ok AS (SELECT * FROM v WHERE weight > 0 AND isfinite(weight) AND uid BETWEEN 0 AND 31),
  f AS (SELECT *, max(CASE WHEN uid = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY step) AS burn, sum(weight) OVER (PARTITION BY step) AS t FROM ok)
  SELECT step, uid, round(CASE WHEN max(burn) = 1 THEN max_by(weight, pos) ELSE sum(weight) / max(t) END, 6) AS weight FROM f GROUP BY step, uid"""
)
def resolve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_rewards(spark, sf_dir).select("step", (F.col("uid") % 40).alias("uid"), F.when(F.col("uid") % 9 == 0, -F.col("reward")).otherwise(F.col("reward")).alias("weight"), F.col("uid").alias("pos"))
    return r6(weights.resolve_weights(r, ["step"], 32), "weight")


@query("WITH u AS (SELECT DISTINCT user_id AS uid FROM events), n AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS i, count(*) OVER () AS c FROM u), t AS (SELECT uid, CAST(((i - (6 * 16) % c) % c + c) % c AS INTEGER) AS turn, c FROM n) SELECT uid, turn FROM t WHERE turn < least(16, c)")
def rotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.rotate(table(spark, sf_dir, "events").select(F.col("user_id").alias("uid")).distinct(), 7, 16)


@query("SELECT c_custkey AS uid FROM customer WHERE c_custkey <> 0 AND NOT (c_nationkey < 5 AND c_acctbal >= 1000) AND c_mktsegment NOT IN ('', '0.0.0.0') AND c_nationkey > 0 AND c_custkey % 3 = 0")
def eligible_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    targets = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("uid"))
    n = c.select(F.col("c_custkey").alias("uid"), (F.col("c_nationkey") < 5).alias("permit"), F.col("c_acctbal").alias("stake"), F.col("c_mktsegment").alias("ip"), F.col("c_nationkey").alias("port"))
    return weights.eligible(n, targets, 1000.0).select("uid")


_EPOCH = """WITH t AS (SELECT o_orderkey, TIMESTAMP '2026-05-01 00:00:00' + INTERVAL 1 HOUR * (o_orderkey % 2000) AS ts FROM orders),
  s AS (SELECT o_orderkey, CAST(epoch(ts) AS BIGINT) AS sec FROM t),
  e AS (SELECT o_orderkey, CASE WHEN sec >= epoch(TIMESTAMP '2026-06-22 20:00:00') AND sec < epoch(TIMESTAMP '2026-06-27 00:00:00') THEN epoch(TIMESTAMP '2026-06-22 20:00:00')
    WHEN sec >= epoch(TIMESTAMP '2026-06-27 00:00:00') THEN epoch(TIMESTAMP '2026-06-27 00:00:00') + floor((sec - epoch(TIMESTAMP '2026-06-27 00:00:00')) / 432000) * 432000
    WHEN sec >= epoch(TIMESTAMP '2026-06-17 20:00:00') THEN epoch(TIMESTAMP '2026-06-17 20:00:00') + floor((sec - epoch(TIMESTAMP '2026-06-17 20:00:00')) / 432000) * 432000
    WHEN sec >= epoch(TIMESTAMP '2026-05-12 20:00:00') THEN epoch(TIMESTAMP '2026-05-12 20:00:00') + floor((sec - epoch(TIMESTAMP '2026-05-12 20:00:00')) / 259200) * 259200
    ELSE floor((sec - 72000) / 86400.0) * 86400 + 72000 END AS a FROM s)
  SELECT strftime(make_timestamp(CAST(a * 1000000 AS BIGINT)), 'day_%Y-%m-%d_%H00utc') AS epoch_id, count(*) AS n FROM e GROUP BY 1"""


@query(_EPOCH)
def epoch_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-05-01 00:00:00").cast("timestamp")) + (F.col("o_orderkey") % 2000) * 3600)
    return table(spark, sf_dir, "orders").groupBy(weights.epoch(ts)["id"].alias("epoch_id")).agg(F.count("*").alias("n"))


# Registries


@query("SELECT sha256(user_id || '|' || event_type) AS fingerprint, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_served, count(*) - 1 AS repeats FROM events GROUP BY 1")
def served_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("fingerprint"), "ts")
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return registry.merge_served(registry.served(e.where(half), "fingerprint", "ts"), registry.served(e.where(~half), "fingerprint", "ts"), "fingerprint")


@query("SELECT o_custkey AS uid, reason, count(*) AS n FROM (SELECT o_custkey, unnest(list_distinct([o_orderstatus, o_orderpriority])) AS reason FROM orders) GROUP BY ALL")
def suspicion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.array_distinct(F.array("o_orderstatus", "o_orderpriority")).alias("reasons"))
    return registry.reason_counts(o, "uid", "reasons")


@query("SELECT user_id, event_id, CAST(age AS INTEGER) AS age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 64")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.recent(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


_MANIFEST = """SELECT o_orderkey AS seen_at, o_custkey AS uid, CASE WHEN o_orderkey % 7 = 0 THEN 'false' ELSE 'true' END AS open_source, CASE WHEN o_orderkey % 5 <> 0 THEN 'repo' WHEN o_orderkey % 10 = 0 THEN 'standard/' END AS repo_url,
  CASE WHEN o_orderkey % 11 = 0 THEN 'xyz' WHEN o_orderkey % 11 = 1 THEN 'ABCDEF0' WHEN o_orderkey % 11 > 2 THEN 'abcdef0' END AS repo_commit, 'm' AS model_name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1' END AS model_version, 't' AS training_data_statement, 'p' AS private_data_attestation,
  CASE WHEN o_orderkey % 13 > 1 THEN 'a.py' WHEN o_orderkey % 13 = 1 THEN ' ' END AS file, CASE WHEN o_orderkey % 17 > 0 THEN 'h' END AS implementation_sha256 FROM orders"""


# Counted by hand from the cases above: what is missing, and what is violated.
@query(
    """WITH s AS (SELECT o_orderkey AS seen_at, o_custkey AS uid, o_orderkey % 7 = 0 AS closed, o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 AS no_repo, o_orderkey % 11 = 2 AS no_commit, o_orderkey % 3 = 0 AS no_version, o_orderkey % 13 < 2 AS no_files, o_orderkey % 17 = 0 AS no_hash,
    o_orderkey % 11 < 3 AS bad_commit, o_orderkey % 10 = 0 AS others_repo FROM orders),
  n AS (SELECT seen_at, uid, CAST(closed AS INT) + CAST(no_repo AS INT) + CAST(no_commit AS INT) + CAST(no_version AS INT) + CAST(no_files AS INT) + CAST(no_hash AS INT) AS n_missing, CAST(bad_commit AS INT) + CAST(others_repo AS INT) AS n_violations FROM s),
  t AS (SELECT *, CASE WHEN n_missing + n_violations = 0 THEN 'transparent' ELSE 'opaque' END AS status FROM n)
  SELECT seen_at, uid, CAST(n_missing AS INTEGER) AS n_missing, CAST(n_violations AS INTEGER) AS n_violations, status, coalesce(lag(status) OVER (PARTITION BY uid ORDER BY seen_at) <> status, TRUE) AS status_changed FROM t"""
)
def compliance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(_MANIFEST.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    m = m.withColumn("implementation_files", F.when(F.col("file").isNotNull(), F.array(F.lit(None).cast("string"), F.col("file"))))
    c = registry.compliance(m, "uid", "seen_at", "standard", "standard-model")
    return c.select("seen_at", "uid", F.size("missing").alias("n_missing"), F.size("violations").alias("n_violations"), "status", "status_changed")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.changes(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def registry_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("status"))
    return registry.without(o, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("uid")), "uid")[1]


@query(
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'provider_completed' WHEN 'error' THEN 'provider_error' WHEN 'click' THEN 'provider_timeout' ELSE 'local_completed' END AS status, value > 50 AS verified FROM events ORDER BY event_id DESC LIMIT 32)
  SELECT count(*) AS recent_report_count, count(*) FILTER (WHERE verified) AS verified_report_count, count(*) FILTER (WHERE status IN ('provider_error', 'provider_timeout')) AS provider_failure_count,
    first(status ORDER BY event_id DESC) AS last_status, first(verified ORDER BY event_id DESC) AS last_proof_verified FROM r"""
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "provider_completed").when(kind == "error", "provider_error").when(kind == "click", "provider_timeout").otherwise("local_completed")
    return registry.status_summary(table(spark, sf_dir, "events").select("event_id", status.alias("status"), (F.col("value") > 50).alias("verified")), "event_id", "status", "verified")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_custkey AS uid, round(t, 2) AS reward, n AS orders FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS t, count(*) AS n FROM orders GROUP BY 1) ORDER BY t DESC, o_custkey LIMIT 10")
def audit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("reward"), F.count("*").alias("orders"))
    return registry.evidence(o, "reward", "uid", ["orders"]).select("uid", F.round("reward", 2).alias("reward"), "orders")


@query("SELECT c.c_custkey AS uid, coalesce(o.n, 0) AS orders, round(coalesce(o.t, 0), 2) AS total, n.n_name AS nation FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS t FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def score_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("t"))
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return j.select(F.col("c_custkey").alias("uid"), F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"), F.col("n_name").alias("nation"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_acctbal >= 5000) AS rich, count(DISTINCT c_nationkey) AS nations FROM customer")
def network_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_acctbal") >= 5000).alias("rich"), F.count_distinct("c_nationkey").alias("nations"))


# Canonical view


@query("SELECT event_id, round(CAST(concat('0x', substring(sha256(user_id || '|' || event_id || '|amount'), 3, 2)) AS INT) / 255.0::DOUBLE * 2 - 1, 6) AS noise, CAST(5 + CAST(concat('0x', substring(sha256(user_id || '|' || event_id), 1, 2)) AS INT) % 4 AS INTEGER) AS window_size FROM events")
def hash_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seed = F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.select("event_id", F.round(sanitize.hash_noise(F.concat(seed, F.lit("|amount"))), 6).alias("noise"), sanitize.window_size(seed).alias("window_size"))


@query(
    f"""WITH b AS (SELECT event_id, greatest(value, 0) AS v, user_id || '|' || event_id AS seed FROM events), k AS (SELECT unnest({list(sanitize.BUCKETS)}) AS k),
  n AS (SELECT event_id, any_value(v) AS v, any_value(seed) AS seed, min_by(k, (abs(k - v), k)) AS k FROM b, k GROUP BY event_id),
  z AS (SELECT *, CAST(concat('0x', substring(sha256(seed), 3, 2)) AS INT) / 255.0::DOUBLE * 2 - 1 AS z FROM n)
  SELECT event_id, CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE round_even(CAST(greatest(0.0, least(126.0, k + z * CASE WHEN k <= 1.5 THEN 0.08 WHEN k <= 8 THEN 0.22 ELSE greatest(0.35, k * 0.05) END)) AS DOUBLE), 2) END AS coarse FROM z"""
)
def coarse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seed = F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.select("event_id", sanitize.coarse(F.greatest("value", F.lit(0.0)), seed).alias("coarse"))


@query(_HANDS + ", o AS (SELECT chunk_id, hand_ix, seat, min(act_ix) AS f FROM act GROUP BY ALL), p AS (SELECT p.chunk_id, p.hand_ix, p.seat, coalesce(o.f, 1000000 + p.seat) AS f FROM play p LEFT JOIN o ON o.chunk_id = p.chunk_id AND o.hand_ix = p.hand_ix AND o.seat = p.seat) SELECT chunk_id, hand_ix, seat, CAST(row_number() OVER (PARTITION BY chunk_id, hand_ix ORDER BY f, seat) AS INTEGER) AS alias FROM p")
def seat_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hands(spark, sf_dir)
    a = t.act.groupBy("chunk_id", "hand_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("act_ix", "seat"))), lambda x: x["seat"]).alias("acted"))
    p = t.play.groupBy("chunk_id", "hand_ix").agg(F.array_sort(F.collect_list("seat")).alias("sat"))
    order = p.join(a, ["chunk_id", "hand_ix"], "left").withColumn("order", sanitize.seat_order(F.col("acted"), F.col("sat"), F.lit(6)))
    return order.select("chunk_id", "hand_ix", F.posexplode("order").alias("i", "seat"), "sat").where(F.array_contains("sat", F.col("seat"))).select("chunk_id", "hand_ix", "seat", (F.col("i") + 1).cast("int").alias("alias"))


@query(
    _HANDS
    + """, l AS (SELECT *, lag(kind) OVER w AS k0, lag(seat) OVER w AS s0, lag(street) OVER w AS t0, lag(amount) OVER w AS a0, lag(pot_after - pot_before) OVER w AS g0 FROM act WINDOW w AS (PARTITION BY chunk_id, hand_ix ORDER BY act_ix))
  SELECT chunk_id, hand_ix, count(*) AS n FROM l WHERE NOT coalesce(amount <= 0 AND pot_after <= pot_before AND kind IN ('check', 'fold') AND k0 = kind AND s0 = seat AND t0 = street AND a0 <= 0 AND g0 <= 0, FALSE) GROUP BY ALL"""
)
def collapse_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("act_ix", F.col("kind").alias("action_type"), F.col("seat").alias("actor_seat"), "street", F.col("amount").alias("normalized_amount_bb"), "pot_before", "pot_after")
    g = hands(spark, sf_dir).act.groupBy("chunk_id", "hand_ix").agg(F.array_sort(F.collect_list(row)).alias("a"))
    return g.select("chunk_id", "hand_ix", F.size(sanitize.collapse(F.col("a"))).cast("long").alias("n"))


@query(
    _HANDS
    + """, n AS (SELECT chunk_id, hand_ix, count(*) AS n, chunk_id || '|' || hand_ix AS seed FROM act GROUP BY ALL),
  w AS (SELECT *, least(n, 5 + CAST(concat('0x', substring(sha256(seed), 1, 2)) AS INT) % 4) AS w FROM n),
  m AS (SELECT a.chunk_id, a.hand_ix, a.act_ix AS i, a.street, w.n, w.w, w.seed FROM act a JOIN w ON w.chunk_id = a.chunk_id AND w.hand_ix = a.hand_ix),
  f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, hand_ix, street ORDER BY sha256(seed || ':' || i || ':' || street)) AS r FROM m WHERE i > 0 AND i < n - 1),
  s AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, hand_ix ORDER BY street) AS k FROM f WHERE r = 1),
  p AS (SELECT chunk_id, hand_ix, i FROM s WHERE k <= w - 2),
  c AS (SELECT chunk_id, hand_ix, count(*) AS c FROM p GROUP BY ALL),
  q AS (SELECT f.*, row_number() OVER (PARTITION BY f.chunk_id, f.hand_ix ORDER BY sha256(seed || ':' || f.i || ':')) AS k FROM f ANTI JOIN p ON p.chunk_id = f.chunk_id AND p.hand_ix = f.hand_ix AND p.i = f.i),
  x AS (SELECT chunk_id, hand_ix, i FROM m WHERE n > 1 AND (n <= w OR i = 0 OR i = n - 1) UNION SELECT p.chunk_id, p.hand_ix, p.i FROM p JOIN w USING (chunk_id, hand_ix) WHERE w.n > w.w
        UNION SELECT q.chunk_id, q.hand_ix, q.i FROM q LEFT JOIN c ON c.chunk_id = q.chunk_id AND c.hand_ix = q.hand_ix WHERE q.n > q.w AND q.k <= q.w - 2 - coalesce(c.c, 0))
  SELECT chunk_id, hand_ix, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS places FROM x GROUP BY ALL"""
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hands(spark, sf_dir).act.groupBy("chunk_id", "hand_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("act_ix", "street"))), lambda x: x["street"]).alias("s"))
    seed = F.concat_ws("|", F.col("chunk_id").cast("string"), F.col("hand_ix").cast("string"))
    return g.where(F.size("s") > 1).select("chunk_id", "hand_ix", F.array_join(F.transform(sanitize.visible_places(F.col("s"), seed), lambda i: i.cast("string")), ",").alias("places"))


@query(
    _HANDS
    + """, n AS (SELECT chunk_id, count(*) AS n, avg(n_streets) AS streets, avg(n_players) AS players FROM hand GROUP BY 1),
  a AS (SELECT chunk_id, count(*) FILTER (WHERE kind = 'call') AS calls, count(*) FILTER (WHERE kind = 'check') AS checks, count(*) FILTER (WHERE kind IN ('bet', 'raise')) AS raises, count(*) FILTER (WHERE kind = 'fold') AS folds, count(*) AS actions, sum(amt_bb) AS amount_bb, sum(pot_after) AS pot_after FROM act GROUP BY 1)
  SELECT chunk_id, """
    + _round("streets", "players")
    + ", "
    + ", ".join(f"round(CAST({c} AS DOUBLE) / n, 6) AS {c}" for c in ("calls", "checks", "raises", "folds", "actions", "amount_bb", "pot_after"))
    + " FROM n JOIN a USING (chunk_id)"
)
def chunk_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hands(spark, sf_dir)
    s = sanitize.chunk_signature(t.hand, t.act)
    return r6(s, *[c for c in s.columns if c != "chunk_id"])


def nested_hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binding as nested documents (chunk_id, hand_ix, hand)."""
    t = hands(spark, sf_dir)
    act = F.struct(F.col("act_ix").cast("string").alias("action_id"), "street", F.col("seat").alias("actor_seat"), F.col("kind").alias("action_type"), "amount", "raise_to", "call_to", F.col("amt_bb").alias("normalized_amount_bb"), "pot_before", "pot_after")
    a = t.act.groupBy("chunk_id", "hand_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("act_ix", act.alias("a")))), lambda x: x["a"]).alias("actions"))
    p = t.play.groupBy("chunk_id", "hand_ix").agg(F.array_sort(F.collect_list(F.struct(F.lit(None).cast("string").alias("player_uid"), "seat", F.col("stack").alias("starting_stack"), F.lit(None).cast("array<string>").alias("hole_cards"), F.lit(False).alias("showed_hand")))).alias("players"))
    h = t.hand.join(a, ["chunk_id", "hand_ix"], "left").join(p, ["chunk_id", "hand_ix"], "left")
    meta = F.struct(F.lit("").alias("game_type"), F.lit("").alias("limit_type"), "max_seats", "hero_seat", F.lit("").alias("hand_ended_on_street"), "button_seat", F.lit(0.25).alias("sb"), "bb", F.lit(0.0).alias("ante"), F.lit(None).cast("string").alias("rng_seed_commitment"))
    return h.select("chunk_id", "hand_ix", F.struct(F.lit(None).cast("string").alias("hand_id"), meta.alias("metadata"), "players", F.expr("cast(array() as array<struct<street:string,board_cards:array<string>>>)").alias("streets"), "actions", F.expr("cast(null as struct<showdown:boolean>)").alias("outcome")).alias("hand"))


@query()
def sanitize_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sanitize.canonical(nested_hands(spark, sf_dir))
    return v.select("chunk_id", "hand_ix", F.to_json("hand").alias("view"))


# Text of hands


_TOK = """, own AS (SELECT a.chunk_id, a.hand_ix, a.act_ix, substring(a.street, 1, 1) || CASE a.kind WHEN 'fold' THEN 'F' WHEN 'check' THEN 'X' WHEN 'call' THEN 'C' WHEN 'bet' THEN 'B' WHEN 'raise' THEN 'R' WHEN 'all_in' THEN 'A' END ||
    CASE WHEN a.amount <= 0 THEN '0' WHEN a.amount / a.pot_before < 0.4 THEN 's' WHEN a.amount / a.pot_before < 0.8 THEN 'm' WHEN a.amount / a.pot_before < 1.5 THEN 'l' ELSE 'o' END AS token
    FROM act a JOIN hand h ON h.chunk_id = a.chunk_id AND h.hand_ix = a.hand_ix WHERE a.seat = h.hero_seat AND a.kind NOT IN ('small_blind', 'big_blind')),
  g AS (SELECT *, lag(token) OVER w AS t1, lag(token, 2) OVER w AS t2 FROM own WINDOW w AS (PARTITION BY chunk_id, hand_ix ORDER BY act_ix)),
  terms AS (SELECT chunk_id, hand_ix, token AS term FROM own UNION ALL SELECT chunk_id, hand_ix, t1 || '_' || token FROM g WHERE t1 IS NOT NULL UNION ALL SELECT chunk_id, hand_ix, t2 || '_' || t1 || '_' || token FROM g WHERE t2 IS NOT NULL
    UNION ALL SELECT h.chunk_id, h.hand_ix, 'pos' || ((h.hero_seat - h.button_seat) % 6 + 6) % 6 FROM hand h
    UNION ALL SELECT h.chunk_id, h.hand_ix, 'len' || least(8, count(o.token)) FROM hand h LEFT JOIN own o ON o.chunk_id = h.chunk_id AND o.hand_ix = h.hand_ix GROUP BY h.chunk_id, h.hand_ix
    UNION ALL SELECT chunk_id, hand_ix, 'nseats' || count(DISTINCT seat) FROM act GROUP BY chunk_id, hand_ix)"""


@query(_HANDS + _TOK + " SELECT chunk_id, term, count(*) AS n FROM terms GROUP BY ALL")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hands(spark, sf_dir)
    docs = tokens.documents(t.hand, t.act)
    return docs.select("chunk_id", F.explode(F.split("doc", " ")).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("n"))


@query(
    _HANDS
    + _TOK
    + """, tf AS (SELECT chunk_id, hand_ix, lower(term) AS term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3),
  w AS (SELECT chunk_id, hand_ix, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM hand)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term))
  SELECT chunk_id, hand_ix, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id, hand_ix)), 6) AS weight FROM w"""
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hands(spark, sf_dir)
    return r6(tokens.tfidf(tokens.documents(t.hand, t.act), ["chunk_id", "hand_ix"]), "weight")


# Two tables at a time are a chunk here, so that some chunks are over the limit of 60 hands.
@query(
    _HANDS
    + """, p AS (SELECT CAST(floor(chunk_id / 2.0) AS BIGINT) AS pair, hand_ix * 2 + chunk_id % 2 AS ix FROM hand), n AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n FROM p),
  w AS (SELECT *, CASE WHEN n <= 60 THEN 0 ELSE CAST(floor(ix / 40.0) AS INTEGER) END AS win FROM n), k AS (SELECT *, count(*) OVER (PARTITION BY pair, win) AS own FROM w)
  SELECT pair, ix, win FROM k WHERE n <= 60 OR own >= 20"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hands(spark, sf_dir).hand.select(F.floor(F.col("chunk_id") / 2).alias("pair"), (F.col("hand_ix") * 2 + F.col("chunk_id") % 2).alias("ix"))
    return tokens.serve_windows(h, ["pair"], "ix").withColumnRenamed("window", "win")


@query(_SCORED + " SELECT uid, round(avg(score), 6) AS score, min_by(label, ord) AS label FROM scored GROUP BY uid")
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(tokens.pooled(scored(spark, sf_dir), ["uid"], "score", "label", "ord"), "score")


@query(_SCORED + " SELECT ord, label, 0 AS pseudo FROM scored UNION ALL SELECT ord, CASE WHEN score > 0.9 THEN 1 ELSE 0 END, 1 FROM scored WHERE score > 0.9 OR score < 0.1")
def pseudo_label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans import model

    s = scored(spark, sf_dir)
    sure = model.pseudo_labels(s).select("ord", "label", F.lit(1).alias("pseudo"))
    return s.select("ord", "label", F.lit(0).alias("pseudo")).unionByName(sure)


@query("SELECT CAST(floor((r - 1) / 100.0) AS BIGINT) AS n, count(*) AS hands, CAST(sum(k) AS BIGINT) AS total FROM (SELECT row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS c, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE floor((r - 1) / 100.0) < floor(c / 100.0) GROUP BY 1")
def count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.longform import in_chunks

    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "struct<k:bigint>")["k"]
    # events carry dense ids, so the place of each is known without a sort of all
    flat = e.select(F.lit("events").alias("file"), F.col("event_id").alias("pos"), k.alias("hand"))
    return in_chunks(flat, 100).groupBy(F.split("chunk_id", "#")[1].cast("long").alias("n")).agg(F.count("*").alias("hands"), F.sum("hand").alias("total"))


# Scans, streams and models


@query(
    _HANDS
    + " SELECT h.chunk_id || '-' || h.hand_ix AS hand_id, h.hero_seat, h.n_players AS players, count(a.act_ix) AS actions, round(coalesce(sum(a.amount), 0), 6) AS amount FROM hand h LEFT JOIN act a ON a.chunk_id = h.chunk_id AND a.hand_ix = h.hand_ix GROUP BY ALL"
)
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hands of the binding, written as text files of JSON arrays and read again by the array reader."""
    from quillon.sources.hands import flat

    named = nested_hands(spark, sf_dir).withColumn("hand", F.col("hand").withField("hand_id", F.concat_ws("-", F.col("chunk_id").cast("string"), F.col("hand_ix").cast("string"))))
    arrays = named.groupBy("chunk_id", F.expr("hand_ix div 1000")).agg(F.to_json(F.collect_list("hand")).alias("value"))
    folder = new_folder(spark, "json")
    arrays.select("value").write.option("maxRecordsPerFile", 100).text(folder)
    read = flat(spark, folder, 1).select("hand.*")
    paid = F.aggregate("actions", F.lit(0.0), lambda acc, a: acc + F.coalesce(a["amount"], F.lit(0.0)))
    found = read.select("hand_id", F.col("metadata.hero_seat").alias("hero_seat"), F.size("players").cast("long").alias("players"), F.size("actions").cast("long").alias("actions"), paid.alias("amount"))
    return r6(found, "amount")


@query("SELECT CAST(user_id AS VARCHAR) AS fingerprint, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_served FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def registry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served registry as a stream over the events' files; of each user the newest row that the cycles wrote."""
    from quillon.streaming.registry import run_cycles, served_stream

    schema = table(spark, sf_dir, "events").schema
    pattern = f"{sf_dir.rstrip('/')}/[e]vents.parquet"  # a stream takes a single file by a pattern only, a folder either way
    stream = spark.readStream.schema(schema).parquet(pattern).where(F.col("user_id").isNotNull())
    rows = served_stream(stream.select(F.col("user_id").cast("string").alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts")))
    out = new_folder(spark, "served")
    # a cycle that is run again writes over its own folder
    run_cycles(rows, new_folder(spark, "stream"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/cycle={n}")).awaitTermination()
    newest = spark.read.parquet(out).groupBy("fingerprint").agg(F.max(F.struct("times_served", "first_seen", "last_seen")).alias("r"))
    at = schema["ts"].dataType
    return newest.select("fingerprint", F.col("r.first_seen").cast(at).alias("first_seen"), F.col("r.last_seen").cast(at).alias("last_seen"), F.col("r.times_served").alias("times_served"))


_ANSWER_HOURS = 6


@query(
    f"""WITH r AS (SELECT event_id AS request_id, user_id AS uid, ts, event_id % 5 + 1 AS n_sent FROM events WHERE event_type = 'view'), a AS (SELECT user_id AS uid, ts, event_id % 5 + 1 AS n_scores FROM events WHERE event_type = 'click'),
  j AS (SELECT r.*, a.ts AS got, a.n_scores, row_number() OVER (PARTITION BY request_id ORDER BY a.ts, a.n_scores) AS k FROM r LEFT JOIN a ON a.uid = r.uid AND a.ts BETWEEN r.ts AND r.ts + INTERVAL {_ANSWER_HOURS} HOUR)
  SELECT uid, request_id, n_sent, coalesce(n_scores, 0) AS n_scores, CASE WHEN n_scores = n_sent THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage, round(CAST(epoch_us(got) - epoch_us(ts) AS DOUBLE) / 1000000, 3) AS latency_seconds FROM j WHERE k = 1"""
)
def response_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as requests and a user's clicks as answers, joined as two streams; a request without an answer comes out when its time is over."""
    from quillon.streaming import responses, runs

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))

    # a view and a click of nobody, long after all others; rows without a key would be left out before the watermark sees them
    stream, more = runs.played([ev, *runs.closing(ev, "ts", _ANSWER_HOURS + 48, user_id=F.lit(-1), event_type=F.explode(F.array(F.lit("view"), F.lit("click"))))])
    n = F.col("event_id") % 5 + 1
    asked = stream.where("event_type = 'view'").select(F.col("user_id").alias("uid"), F.col("event_id").alias("request_id"), F.col("ts").alias("sent_at"), n.alias("n_sent"))
    replies = stream.where("event_type = 'click'").select(F.col("user_id").alias("uid"), F.lit(None).cast("long").alias("request_id"), F.col("ts").alias("got_at"), n.alias("n_scores"))
    settled = responses.answered(asked, replies, f"{_ANSWER_HOURS} HOURS", "1 hour", by_request=False)
    out = runs.drain(settled, new_folder(spark, "stream"), new_folder(spark, "responses"), "append", more).where("request_id is not null")
    return out.select("uid", "request_id", "n_sent", F.coalesce("n_scores", F.lit(0)).alias("n_scores"), "coverage", F.round("latency_seconds", 3).alias("latency_seconds"))


@query(
    """WITH e AS (SELECT user_id AS uid, event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [event_type, 'third'] ELSE [event_type] END) AS reason FROM events),
  r AS (SELECT user_id AS uid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events)
  SELECT uid, 'count' AS part, reason AS item, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT uid, 'event' AS part, CAST(event_id AS VARCHAR) AS item, age AS n FROM r WHERE age <= 64"""
)
def suspicion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspicion registry as keyed state over the events in three cycles: counts of each reason, and the last 64 events with their age."""
    from quillon.streaming import runs, suspicion

    kind = F.when(F.col("event_id") % 3 == 0, F.array("event_type", F.lit("third"))).otherwise(F.array("event_type"))
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), "event_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("reasons")).where("uid is not null")
    stream, more = runs.played([ev.where(F.col("event_id") % 3 == i) for i in range(3)])
    entries = suspicion.latest(runs.drain(suspicion.suspicion_stream(stream), new_folder(spark, "stream"), new_folder(spark, "suspicion"), then=more))
    counts = entries.select("uid", F.explode("counts").alias("item", "n")).select("uid", F.lit("count").alias("part"), "item", "n")
    events = entries.select("uid", F.size("events").alias("k"), F.posexplode("events").alias("i", "e"))  # oldest first
    return counts.unionByName(events.select("uid", F.lit("event").alias("part"), F.col("e.event_id").cast("string").alias("item"), (F.col("k") - F.col("i")).cast("long").alias("n")))


# Two hours of orders for each of theirs, so that all eras and the bridge occur.
@query(_EPOCH.replace("o_orderkey % 2000", "o_orderkey % 1700").replace("SELECT strftime", "SELECT CAST(a AS BIGINT) AS start_seconds, strftime").replace("GROUP BY 1", "GROUP BY ALL"))
def epoch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by epoch of the calendar, as a stream in event time: an epoch comes out when the watermark passes its end."""
    from quillon.streaming import calendar, runs

    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-05-01 00:00:00").cast("timestamp")) + (F.col("o_orderkey") % 1700) * 3600)
    orders = table(spark, sf_dir, "orders").select(ts.alias("ts"))
    half = F.lit("2026-06-05").cast("timestamp")
    stream, more = runs.played([orders.where(F.col("ts") < half), orders.where(F.col("ts") >= half), *runs.closing(orders, "ts", 400)])
    out = runs.drain(calendar.epoch_stream(stream), new_folder(spark, "stream"), new_folder(spark, "epochs"), "append", more)
    last = orders.agg(F.max("ts").alias("last"))  # one row; epochs that begin later are of closing rows
    return out.join(F.broadcast(last), F.col("start") <= F.col("last")).select("epoch_id", F.unix_timestamp("start").alias("start_seconds"), "n")


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN CAST(user_id % 9 AS VARCHAR) ELSE 'True' END || '|' || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS seed FROM events)
  SELECT event_id, seed, round(CAST(CAST('0x' || substring(sha256(seed), 3, 2) AS INTEGER) AS DOUBLE) / 255.0 * 2.0 - 1.0, 6) AS noise FROM s"""
)
def variant_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash seeds from VARIANT: a missing field, a null, a number and a boolean differ."""
    from quillon.operators import variants

    seat = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, '"seat":null,').when(F.col("event_id") % 4 == 2, F.concat(F.lit('"seat":'), (F.col("user_id") % 9).cast("string"), F.lit(","))).otherwise('"seat":true,')
    kind = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit('"kind":"'), "event_type", F.lit('",')))
    v = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.concat(F.lit('{"m":{'), seat, kind, F.lit('"x":1}}'))).alias("v"))
    seed = F.concat_ws("|", *[variants.seed_text(variants.field(F.col("v"), f"$.m.{p}")) for p in ("seat", "kind")])
    return r6(v.select("event_id", seed.alias("seed")).withColumn("noise", sanitize.hash_noise(F.col("seed"))), "noise")


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
  SELECT event_id, 'props/k' AS path, k AS metric FROM e UNION ALL SELECT event_id, 'deep/a/b/even' AS path, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metric FROM e
  UNION ALL SELECT event_id, 'deep/list_count' AS path, CAST(event_id % 3 AS DOUBLE) AS metric FROM e WHERE event_id % 3 > 0"""
)
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every event flattened without a schema, after a key was dropped at every depth."""
    from quillon.operators import variants

    items = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, ',"list":[{"label":1}]').otherwise(',"list":[1,"x"]')
    even = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    report = F.concat(F.lit('{"label":1,"props":'), "props", F.lit(',"deep":{"a":{"b":{"label":"bot","even":'), even, F.lit(',"none":null,"text":"t"}}'), items, F.lit("}}"))
    kept = table(spark, sf_dir, "events").select("event_id", F.parse_json(variants.drop_keys(report, sanitize.PRIVATE)).alias("v"))
    return variants.flat_metrics(kept, ["event_id"], "v")


_PAGE = 100


@query(
    f"""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id, user_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS i FROM events WHERE ts IS NOT NULL)
  SELECT date, CAST(i // {_PAGE} AS INTEGER) AS page, CAST(i % {_PAGE} AS INTEGER) AS pos, event_id, user_id FROM e"""
)
def paged_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dump of pages by day, each under a cursor that tells nothing of its place, many to a file; followed and landed in two runs."""
    from quillon.sources import paged

    e = table(spark, sf_dir, "events").where("ts is not null").select(F.to_date("ts").cast("string").alias("date"), "event_id", "user_id")
    numbered = running(e.withColumn("one", F.lit(1)), ["date"], ["event_id"], {"i": "one"}).withColumn("i", F.col("i") - 1)
    numbered = numbered.withColumn("page", F.expr(f"i div {_PAGE}")).withColumn("last", F.expr(f"(all_i - 1) div {_PAGE}"))
    cursor = lambda page: F.when(page == 0, F.lit("start")).otherwise(F.md5(F.concat_ws(":", "date", page.cast("string"))))
    pages = numbered.groupBy("date", "page", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_id", "user_id"))), lambda x: F.struct(x["event_id"].alias("event_id"), x["user_id"].alias("user_id"))).alias("chunks"))
    pages = pages.withColumn("next", F.when(F.col("page") < F.col("last"), cursor(F.col("page") + 1)))
    body = F.to_json(F.struct(F.struct("chunks", F.col("next").alias("nextCursor")).alias("data")))
    dump, out = new_folder(spark, "dump"), new_folder(spark, "landed")
    written = materialised(pages.select("date", "page", F.concat(cursor(F.col("page")), F.lit("\t"), body).alias("value")))
    written.where("page < 2").select("date", "value").write.partitionBy("date").text(dump)
    paged.land_pages(spark, dump, out)  # days with more pages stop at one that isn't there yet
    written.where("page >= 2").select("date", "value").write.mode("append").partitionBy("date").text(dump)
    got = paged.land_pages(spark, dump, out).withColumn("r", F.from_json("record", "event_id long, user_id long"))
    return got.select("date", "page", "pos", "r.event_id", "r.user_id")


@query("SELECT event_id, CAST(event_id % 5 AS BIGINT) AS batch FROM events WHERE event_id % 5 < 3")
def ready_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in five batches behind a gate, of which the fourth isn't ready: the stream ends before it, the fifth included."""
    from quillon.sources import paged
    from quillon.streaming import runs

    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("batch"), "event_id").where("batch is not null")
    root = new_folder(spark, "gate")
    e.select("batch", F.to_json(F.struct("event_id")).alias("value")).write.partitionBy("batch").text(f"{root}/hands")
    status = e.groupBy("batch").agg(F.count("*").alias("available")).select("batch", (F.col("batch") != 3).alias("ready"), "available")
    status.write.json(f"{root}/status")
    rows = runs.drain(paged.ready_batches(spark, f"{root}/hands", f"{root}/status", 1), f"{root}/checkpoint", f"{root}/out", "append")
    return rows.select(F.get_json_object("hand", "$.event_id").cast("long").alias("event_id"), "batch")


@query()
def hand_text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk scores from the tokens of the hero's actions; a chunk's label is whether its hero raises more than it folds, learned on two thirds of the chunks."""
    from quillon.plans import handtext

    t = hands(spark, sf_dir)
    own = t.act.join(t.hand.select("chunk_id", "hand_ix", "hero_seat"), ["chunk_id", "hand_ix"]).where("seat = hero_seat")
    labels = own.groupBy("chunk_id").agg((F.count_if(F.col("kind").isin("raise", "all_in")) > F.count_if(F.col("kind") == "fold")).cast("int").alias("label"))
    docs = materialised(tokens.documents(t.hand, t.act).join(labels, "chunk_id"))
    fitted = handtext.fit(docs.where("chunk_id % 3 <> 0"), rounds=10, depth=4)
    return r6(handtext.chunk_scores(fitted, docs), "score")


@query()
def stack_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a stack that learns their quality from the shape of the labelled ones' texts."""
    from quillon.plans.model import Stack

    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"\s+"), "")
    rate = lambda part, whole: F.when(whole > 0, part / whole)
    shape = {
        "chars": F.log1p(F.length(text).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "distinct": rate(F.size(F.array_distinct(words)), F.size(words)),
        "letters": rate(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(text)),
        "capitals": rate(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), F.length(text)),
        "figures": rate(F.length(F.regexp_replace(text, r"[^0-9]+", "")), F.length(text)),
    }
    docs = materialised(table(spark, sf_dir, "documents").select("doc_id", *[c.cast("double").alias(n) for n, c in shape.items()]))
    known = docs.join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    stack = Stack(list(shape), ("forest", "linear"), k=3).fit(known, "doc_id")
    return r6(stack.transform(docs).select("doc_id", "score"), "score")
