"""Ranking and threshold metrics of scored rows, by group.

Input columns: the group columns, `score` double, `label` 0/1, and an ordinal
that stands for input order where ties are broken by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.ranks import quantiles, running


def _safe(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def average_precision(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, ap: equal scores are one step; 0 without a positive. Scores are counted before they are ranked."""
    steps = df.groupBy(*by, score).agg(F.sum(label).alias("tp"), F.count("*").alias("n"))
    steps = running(steps, by, [F.desc(score)], {"hits": "tp", "asked": "n"})
    part = _safe(F.col("tp"), F.col("all_hits")) * _safe(F.col("hits"), F.col("asked"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("ap"))


def recall_at_fpr(df: DataFrame, by: list[str], order: str, score: str = "score", label: str = "label", most: float = 0.05) -> DataFrame:
    """by, recall, fpr: the best recall over prefixes of the ranking whose false-positive rate is at most `most`, and that rate.

    Ties are ranked by `order`. 0, 0 where a class is missing.
    """
    rows = df.select(*by, score, order, F.col(label).alias("__pos"), (F.lit(1) - F.col(label)).alias("__neg"))
    ranked = running(rows, by, [F.desc(score), F.col(order)], {"hits": "__pos", "misses": "__neg"})
    ranked = ranked.select(*by, _safe(F.col("hits"), F.col("all_hits")).alias("recall"), _safe(F.col("misses"), F.col("all_misses")).alias("fpr"))
    best = F.max(F.when(F.col("fpr") <= most, F.struct("recall", (-F.col("fpr")).alias("less"))))
    found = ranked.groupBy(*by).agg(best.alias("best"))
    return found.select(*by, F.coalesce("best.recall", F.lit(0.0)).alias("recall"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("fpr"))


def ranking(df: DataFrame, by: list[str], order: str, score: str = "score", label: str = "label", most: float = 0.05, bounded: bool = False) -> DataFrame:
    """by, ap, recall, fpr of average_precision and recall_at_fpr from one ranking of the rows.

    bounded: groups are small for sure, so each is ranked in one task and all
    stays where the group is; else groups may span tasks.
    """
    rows = df.select(*by, score, order, F.col(label).alias("__pos"), (F.lit(1) - F.col(label)).alias("__neg"))
    if bounded:
        every = Window.partitionBy(*by)
        upto = every.orderBy(F.desc(score), F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
        ranked = rows.select(*by, score, "__pos", *[F.sum(c).over(w).alias(n) for n, c, w in (("hits", "__pos", upto), ("misses", "__neg", upto), ("all_hits", "__pos", every), ("all_misses", "__neg", every))])
    else:
        ranked = running(rows, by, [F.desc(score), F.col(order)], {"hits": "__pos", "misses": "__neg"})
    recall, fpr = _safe(F.col("hits"), F.col("all_hits")), _safe(F.col("misses"), F.col("all_misses"))
    best = F.max(F.when(fpr <= most, F.struct(recall.alias("recall"), (-fpr).alias("less")))).alias("best")
    steps = ranked.groupBy(*by, score).agg(F.sum("__pos").alias("tp"), F.max("hits").alias("hits"), F.max(F.col("hits") + F.col("misses")).alias("asked"), F.max("all_hits").alias("all_hits"), best)
    ap = F.coalesce(F.sum(_safe(F.col("tp"), F.col("all_hits")) * _safe(F.col("hits"), F.col("asked"))), F.lit(0.0))
    found = steps.groupBy(*by).agg(ap.alias("ap"), F.max("best").alias("best"))
    return found.select(*by, "ap", F.coalesce("best.recall", F.lit(0.0)).alias("recall"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("fpr"))


def threshold_metrics(df: DataFrame, by: list[str], at: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """by, hard_recall, hard_fpr, positive_rate, sanity at a fixed threshold."""
    hard, pos = F.col(score) >= at, F.col(label) == 1
    n = df.groupBy(*by).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"), F.count_if(hard & pos).alias("tp"), F.count_if(hard & ~pos).alias("fp"), F.avg(hard.cast("int")).alias("positive_rate"))
    recall, fpr = _safe(F.col("tp"), F.col("p"), 0.0), _safe(F.col("fp"), F.col("n"), 0.0)
    sanity = F.when((F.col("p") == 0) | (F.col("n") == 0), 1.0).when(F.col("tp") == 0, 0.0).when(fpr <= 0.10, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (fpr - 0.10) / 0.90))
    return n.select(*by, recall.alias("hard_recall"), fpr.alias("hard_fpr"), F.coalesce("positive_rate", F.lit(0.0)).alias("positive_rate"), sanity.alias("sanity"))


def rewards(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, ap, recall, fpr, sanity, reward_v1 (.75 AP + .25 recall), reward_v2 (with safety, calibration and latency terms)."""
    m = ranking(df, by, order).join(threshold_metrics(df, by), by)
    v2 = 0.35 * F.col("ap") + 0.30 * F.col("recall") + 0.20 * F.col("sanity") + 0.10 * F.col("sanity") + F.lit(0.05)
    return m.withColumn("reward_v1", 0.75 * F.col("ap") + 0.25 * F.col("recall")).withColumn("reward_v2", F.when(F.col("sanity") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v2))))


def stability(daily: DataFrame, reward: str = "reward_v2") -> DataFrame:
    """mean_daily, std_daily (sample; null for one day), sel_score = mean - std / 2."""
    mean, std = F.avg(reward), F.stddev_samp(reward)
    return daily.agg(mean.alias("mean_daily"), std.alias("std_daily"), (mean - 0.5 * std).alias("sel_score"))


def balance(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, balance: the smaller of the shares of scores under .2 and over .8."""
    return df.groupBy(*by).agg(F.least(F.avg((F.col(score) < 0.2).cast("int")), F.avg((F.col(score) > 0.8).cast("int"))).alias("balance"))


def threshold_scan(df: DataFrame, rates: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """rate, threshold (the quantile 1 - rate of scores), n_tp, fpr, sanity, safe: for each rate of positives asked.

    Thresholds come from counted scores; rows are then read once, with a pair of counts for each threshold in one aggregate.
    """
    cuts = quantiles(df, [], score, [1 - r for r in rates]).agg(F.array_sort(F.collect_list(F.struct("level_ix", "quantile"))).alias("cuts"))  # one row
    hard, pos = lambda i: F.col(score) >= F.get("cuts", F.lit(i))["quantile"], F.col(label) == 1
    counts = [F.struct(F.lit(float(r)).alias("rate"), F.max(F.get("cuts", F.lit(i))["quantile"]).alias("threshold"), F.count_if(hard(i) & pos).alias("n_tp"), F.count_if(hard(i) & ~pos).alias("fp")) for i, r in enumerate(rates)]
    n = df.select(score, label).join(F.broadcast(cuts), F.lit(True), "cross").agg(F.count_if(~pos).alias("n"), F.array(*counts).alias("c")).select("n", F.explode("c").alias("c")).select("n", "c.*")
    fpr = _safe(F.col("fp"), F.col("n"), 0.0)
    sanity = F.when(F.col("n_tp") == 0, 0.0).when(fpr <= 0.10, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (fpr - 0.10) / 0.90))
    return n.where("threshold is not null").select("rate", "threshold", "n_tp", fpr.alias("fpr"), sanity.alias("sanity"), (fpr <= 0.10).alias("safe"))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group in order; groups with fewer are marked by `enough` false."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).withColumn("enough", F.count("*").over(Window.partitionBy(*by)) >= n).where(F.col("__r") <= n).drop("__r")


def windowed_rewards(df: DataFrame, by: list[str], order: str, n: int, coverage: str | None = None, latency: str | None = None) -> DataFrame:
    """by, sample_count, ap, recall, fpr, reward of the last n predictions; zeros and fpr 1 where there are fewer than n.

    With `coverage` also coverage_rate, its mean over those rows (0 without a
    value), with `latency` latency_mean_seconds (null without one), of short
    groups too. A window of under one is one.
    """
    recent = last_n(df, by, order, max(1, n))
    means = ([F.coalesce(F.avg(coverage), F.lit(0.0)).alias("coverage_rate")] if coverage else []) + ([F.avg(latency).alias("latency_mean_seconds")] if latency else [])
    counts = recent.groupBy(*by).agg(F.count("*").alias("sample_count"), F.max("enough").alias("enough"), *means)
    m = counts.join(ranking(recent, by, order, bounded=True), by)
    pick = lambda c, other: F.when(F.col("enough"), F.col(c)).otherwise(F.lit(other)).alias(c)
    m = m.withColumn("reward", 0.75 * F.col("ap") + 0.25 * F.col("recall"))
    extra = [c for c, on in (("coverage_rate", coverage), ("latency_mean_seconds", latency)) if on]
    return m.select(*by, "sample_count", pick("ap", 0.0), pick("recall", 0.0), pick("fpr", 1.0), pick("reward", 0.0), *extra)


def valid_responses(sent: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """by, n_sent, n_scores, coverage: an answer counts only if it has a score for each chunk that was sent."""
    a, b = sent.groupBy(*by).agg(F.count("*").alias("n_sent")), answers.groupBy(*by).agg(F.count("*").alias("n_scores"))
    both = a.join(b, by, "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
    return both.withColumn("coverage", F.when(F.col("n_sent") == F.col("n_scores"), 1.0).otherwise(0.0))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 40) -> DataFrame:
    """by, bin, n: equal bins of [0, 1], the last one closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int")
    return df.where(F.col(value).between(0, 1)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, by: list[str], grid: int = 400, bins: int = 2000) -> DataFrame:
    """by, x, density: a Gaussian kernel estimate on a grid of [0, 1] by Scott's rule, from fine bins.

    Work is bins times grid for each group, whatever the rows. No row for groups without spread.
    """
    binned = histogram(df, value, by, bins).withColumn("c", (F.col("bin") + 0.5) / bins)
    s = df.groupBy(*by).agg(F.stddev_samp(value).alias("s"), F.count(value).alias("m")).where("s > 0").withColumn("h", F.col("s") * F.pow(F.col("m"), F.lit(-0.2)))
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: i / F.lit(float(grid - 1)))).alias("x")
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("c")) / F.col("h"), 2)) / (F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
    return binned.join(s, by).select("*", x).groupBy(*by, "x").agg((F.sum(F.col("n") * k) / F.first("m")).alias("density"))


def reward_summary(df: DataFrame, reward: str, others: list[str]) -> DataFrame:
    """min, max, mean and count of non-zero rewards, means of other metrics."""
    r = F.col(reward)
    return df.agg(F.min(r).alias("reward_min"), F.max(r).alias("reward_max"), F.avg(r).alias("reward_mean"), F.count_if(r != 0).alias("reward_nonzero"), *[F.avg(c).alias(f"{c}_mean") for c in others])


def drawn(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^60 - 1 that follows from the MD5 of the parts, joined by colons: the same in every run and engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def day_bootstrap(days: DataFrame, day: str, fp: str, n: str, draws: int = 300, q: float = 0.95, seed: int = 0) -> DataFrame:
    """fpr_upper: quantile of the false-positive rate over draws of days with replacement; a day drawn twice counts once.

    days: a row for each day with its false positives and negatives. Draws come
    from a hash of seed, draw and place, so every run draws alike.
    """
    listed = days.agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col(fp).alias("f"), F.col(n).alias("n")))).alias("days"))  # days, not rows
    each = listed.select("days", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("days")), lambda i: F.pmod(drawn(seed, F.col("draw"), i), F.size("days")).cast("int") + 1))
    taken = each.select("draw", F.explode(F.transform(pick, lambda i: F.element_at("days", i))).alias("x"))
    return taken.groupBy("draw").agg(_safe(F.sum("x.f"), F.sum("x.n"), 0.0).alias("fpr")).agg(F.percentile("fpr", F.lit(q)).alias("fpr_upper"))


def window_objective(df: DataFrame, fractions: list[float], order: str = "ord", windows: int = 66, size: int = 40, score: str = "score", label: str = "label", seed: int = 0) -> DataFrame:
    """fraction, objective: mean reward_v2 of random windows less three times the share of windows with reward 0.

    A window holds round(size x fraction) positives and the rest negatives,
    drawn with replacement by hashes of seed, fraction's index, window and
    place. Each class is numbered once in the order of a hash of `order`, which
    tells rows apart; a window looks up its places, so no row is copied for
    windows that don't use it. A class without rows leaves its places out.
    """
    rows = df.select(score, label, F.lit(1).alias("one"), drawn(seed, F.col(order)).alias("h"), order)
    numbered = running(rows, [label], ["h", order], {"place": "one"}).select(score, label, (F.col("place") - 1).alias("place"))
    totals = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("total"))  # two rows
    asks = [(k, f, w, i, int(i < round(size * f))) for k, f in enumerate(fractions) for w in range(windows) for i in range(size)]
    asked = df.sparkSession.createDataFrame(asks, "k int, fraction double, w int, ord int, __label int").join(totals, "__label")
    asked = asked.withColumn("place", F.pmod(drawn(seed, F.col("k"), F.col("w"), F.col("ord")), F.col("total")))
    taken = numbered.withColumnRenamed(label, "__label").join(asked, ["__label", "place"]).select("fraction", "w", "ord", F.col(score).alias("score"), F.col("__label").alias("label"))
    r = rewards(taken, ["fraction", "w"], "ord")
    return r.groupBy("fraction").agg((F.avg("reward_v2") - 3.0 * F.avg((F.col("reward_v2") == 0).cast("int"))).alias("objective"))
