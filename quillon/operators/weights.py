"""Scores over cycles: moving averages, winners, weights, rotation, eligibility, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ranks import running

QUANTUM = 65535


def ema(rewards: DataFrame, alpha: float = 0.05, uid: str = "uid", step: str = "step", reward: str = "reward") -> DataFrame:
    """uid, score after the last step: s <- alpha r + (1 - alpha) s at every step of the table, reward 0 where a uid has none.

    Closed form: the sum of alpha (1 - alpha)^(T - t) r_t, so one aggregate and no order.
    """
    last = rewards.agg(F.max(step).alias("__t"))
    w = F.lit(alpha) * F.pow(F.lit(1 - alpha), (F.col("__t") - F.col(step)).cast("double")) * F.coalesce(F.col(reward), F.lit(0.0))
    return rewards.join(F.broadcast(last), F.lit(True), "cross").groupBy(uid).agg(F.sum(w).alias("score"))  # one row


def ema_since_turnover(rewards: DataFrame, alpha: float = 0.05, uid: str = "uid", step: str = "step", reward: str = "reward", key: str = "hotkey") -> DataFrame:
    """As ema, but a uid whose key changed starts from 0 at its last change."""
    w = Window.partitionBy(uid).orderBy(step)
    changed = F.coalesce(F.lag(key).over(w) != F.col(key), F.lit(False))
    era = F.sum(changed.cast("int")).over(w)
    marked = rewards.withColumn("__era", era).withColumn("__now", F.max("__era").over(Window.partitionBy(uid)))
    return ema(marked.withColumn(reward, F.when(F.col("__era") == F.col("__now"), F.col(reward))), alpha, uid, step, reward)


def winner(rewards: DataFrame, by: list[str], uid: str = "uid", reward: str = "reward") -> DataFrame:
    """by, winner: the highest reward, ties to the smaller uid; uid 0 if none is over 0."""
    best = F.max(F.struct(F.col(reward).alias("r"), (-F.col(uid)).alias("u")))
    return rewards.groupBy(*by).agg(best.alias("b")).select(*by, F.when(F.col("b.r") > 0, -F.col("b.u")).otherwise(0).cast("long").alias("winner"))


def resolve_weights(entries: DataFrame, by: list[str], n_uids: int, uid: str = "uid", weight: str = "weight", order: str = "pos") -> DataFrame:
    """by, uid, weight: valid entries (finite, over 0, uid in range) as shares; raw, the last of a uid wins, where uid 0 takes part."""
    ok = entries.where(F.col(weight).isNotNull() & ~F.isnan(weight) & (F.abs(weight) < float("inf")) & (F.col(weight) > 0) & F.col(uid).between(0, n_uids - 1))
    burn = F.max((F.col(uid) == 0).cast("int")).over(Window.partitionBy(*by)) == 1
    ok = ok.withColumn("__burn", burn).withColumn("__total", F.sum(weight).over(Window.partitionBy(*by)))
    out = ok.groupBy(*by, uid).agg(F.max_by(weight, order).alias("raw"), F.sum(weight).alias("all"), F.first("__burn").alias("__burn"), F.first("__total").alias("__total"))
    return out.select(*by, uid, F.when(F.col("__burn"), F.col("raw")).otherwise(F.col("all") / F.col("__total")).alias("weight"))


def quantise(weights: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Weights clipped at 0, as shares, and as whole 1/65535ths (truncated)."""
    w = F.greatest(F.col(weight), F.lit(0.0))
    share = F.coalesce(F.try_divide(w, F.sum(w).over(Window.partitionBy(*by))), F.lit(0.0))
    return weights.withColumn("share", share).withColumn("q", F.floor(F.col("share") * QUANTUM).cast("int"))


def rotate(uids: DataFrame, cycle: int, k: int, uid: str = "uid") -> DataFrame:
    """The k uids whose turn it is in a cycle (from 1), wrapping around the sorted list of distinct uids."""
    numbered = running(uids.select(uid).distinct().withColumn("one", F.lit(1)), [], [F.col(uid)], {"i": "one"})
    n = F.col("all_i")
    turn = F.pmod(F.col("i") - 1 - F.pmod(F.lit((cycle - 1) * k), n), n)
    return numbered.withColumn("turn", turn.cast("int")).where(F.col("turn") < F.least(F.lit(k), n)).select(uid, "turn")


def eligible(neurons: DataFrame, targets: DataFrame | list[int] | None = None, stake_limit: float = 0.0) -> DataFrame:
    """Neurons that may be asked: not uid 0, in the target list (or DataFrame with `uid`) if there is one, no permit with stake, a usable address."""
    ok = (F.col("uid") != 0) & ~(F.col("permit") & (F.col("stake") >= stake_limit)) & F.col("ip").isNotNull() & ~F.col("ip").isin("", "0.0.0.0") & (F.col("port") > 0)
    if isinstance(targets, DataFrame):
        return neurons.where(ok).join(targets.select("uid").distinct(), "uid", "left_semi")
    return neurons.where(ok & F.col("uid").isin(targets) if targets else ok)


#: Epochs: from when, anchor, hours. Before the first: 24 hours from 20:00.
_ERAS = (("2026-05-12 20:00:00", 72), ("2026-06-17 20:00:00", 120), ("2026-06-27 00:00:00", 120))
_BRIDGE = ("2026-06-22 20:00:00", "2026-06-27 00:00:00")


def epoch(ts: Column) -> Column:
    """struct(id, start, end) of the epoch that a UTC time is in."""
    sec, at = F.unix_timestamp(ts), lambda s: F.unix_timestamp(F.lit(s).cast("timestamp"))
    day = F.floor((sec - 20 * 3600) / 86400) * 86400 + 20 * 3600
    start, hours = day, F.lit(24)
    for anchor, h in _ERAS:
        since = F.floor((sec - at(anchor)) / (h * 3600)) * (h * 3600) + at(anchor)
        # within a three or five day epoch the day's own start may lie before the anchor's
        start, hours = F.when(sec >= at(anchor), since).otherwise(start), F.when(sec >= at(anchor), F.lit(h)).otherwise(hours)
    bridge = (sec >= at(_BRIDGE[0])) & (sec < at(_BRIDGE[1]))
    start = F.when(bridge, at(_BRIDGE[0])).otherwise(start)
    end = F.when(bridge, at(_BRIDGE[1])).otherwise(start + hours * 3600)
    s, e = F.timestamp_seconds(start), F.timestamp_seconds(end)
    return F.struct(F.concat(F.lit("day_"), F.date_format(s, "yyyy-MM-dd"), F.lit("_"), F.date_format(s, "HH"), F.lit("00utc")).alias("id"), s.alias("start"), e.alias("end"))
