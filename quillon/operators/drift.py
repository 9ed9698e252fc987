"""Drift between two feature frames, rule filters, feature screening and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.ranks import quantiles, running

MOST_RULES = 10_000


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, x): a row for each value; values that are no number are null."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.feature", F.when(~F.isnan("f.x"), F.col("f.x")).alias("x"))


def out_of_domain(bench: DataFrame, live: DataFrame, columns: list[str], limit: float = 5.0, least: int = 20) -> DataFrame:
    """feature, z, robust: |mean live - mean bench| in sample standard deviations of bench.

    Fewer than `least` values on a side: no z, not robust. No spread: z is
    infinite, not robust, even where means are equal.
    """
    a = long_form(bench, columns).groupBy("feature").agg(F.count("x").alias("na"), F.avg("x").alias("ma"), F.stddev_samp("x").alias("sa"))
    b = long_form(live, columns).groupBy("feature").agg(F.count("x").alias("nb"), F.avg("x").alias("mb"))
    gap = F.abs(F.col("mb") - F.col("ma"))
    z = F.when((F.col("na") < least) | (F.col("nb") < least), None).when(F.col("sa") < 1e-9, F.lit(float("inf"))).otherwise(gap / F.col("sa"))
    out = a.join(b, "feature").withColumn("z", z)
    return out.select("feature", "z", F.coalesce(F.col("z") <= limit, F.lit(False)).alias("robust"))


def rule_filter(names: DataFrame, rules: DataFrame, column: str = "feature") -> DataFrame:
    """column, reason: the first rule (rank) that excludes a name, null if none does. rules: rank, kind exact|substring, pattern, reason.

    Rules are a written list; more than MOST_RULES of them are an error, since each name is held against all.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    n = F.lower(F.col(column))
    hit = F.when(F.col("kind") == "exact", n == F.lower("pattern")).otherwise(n.contains(F.lower(F.col("pattern"))))
    found = names.join(F.broadcast(rules), hit, "left")
    return found.groupBy(column).agg(F.min_by("reason", "rank").alias("reason"))


def screen(df: DataFrame, columns: list[str], label: str = "label", day: str | None = None) -> DataFrame:
    """feature, auc, ks: how well each feature alone ranks the label, and the largest gap between the classes' distributions.

    Values are counted before they are ranked; ties share their step.
    """
    x = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("y", "f.feature", "f.x").where("x is not null and not isnan(x)")
    steps = x.groupBy("feature", "x").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    cp, cn, tp, tn = F.col("cp"), F.col("cn"), F.col("all_cp"), F.col("all_cn")
    ranked = running(steps, ["feature"], ["x"], {"cp": "p", "cn": "n"}).select("feature", tp.alias("tp"), tn.alias("tn"), (F.col("p") * (cn - F.col("n") / 2.0)).alias("u"), F.abs(F.try_divide(cp.cast("double"), tp) - F.try_divide(cn.cast("double"), tn)).alias("gap"))
    return ranked.groupBy("feature").agg(F.try_divide(F.sum("u").cast("double"), (F.first("tp") * F.first("tn")).cast("double")).alias("auc"), F.max("gap").alias("ks"))


def select_features(columns: list[str], screened: DataFrame | None = None, prefixes: tuple[str, ...] = (), allow: list[str] | None = None, ks_max: float = 1.0, auc_min: float = 0.0) -> list[str]:
    """Names to keep: the allow list if given (missing ones are an error), else those of the prefixes that pass ks < ks_max and auc >= auc_min.

    screened has a row for each feature, which is what reaches the driver.
    """
    if allow is not None:
        if missing := sorted(set(allow) - set(columns)):
            raise ValueError(f"not in the frame: {missing}")
        return [c for c in columns if c in set(allow)]
    chosen = [c for c in columns if not prefixes or c.startswith(prefixes)]
    if screened is None:
        return chosen
    passed = {r["feature"] for r in screened.where((F.col("ks") < ks_max) & (F.col("auc") >= auc_min)).select("feature").collect()}
    return [c for c in chosen if c in passed]


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the median of each column, null for one without a value. Values are counted and ranked over range partitions."""
    found = quantiles(long_form(df, columns), ["feature"], "x", [0.5])
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in columns])


def impute(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """df with nulls and NaN of `columns` replaced by the one row of medians."""
    m = fitted.select(*[F.col(c).alias(f"__{c}") for c in columns])
    filled = df.join(F.broadcast(m), F.lit(True), "cross")  # one row
    return filled.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])
