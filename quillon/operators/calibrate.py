"""Score calibration: quantile maps, logit shift, threshold search and the score contract."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.ranks import quantiles
from quillon.operators.drift import long_form

CLIP = 1e-7


@dataclass(frozen=True)
class QuantileMap:
    """Quantiles of each column at equal steps; maps values to ranks by interpolation, and on to a normal if asked."""

    levels: list[float]
    quantiles: dict[str, list[float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], most: int = 200) -> QuantileMap:
        """From at most `most` quantiles of each column: a bounded number of values reaches the driver."""
        n = max(2, min(most, df.count()))
        levels = [i / (n - 1) for i in range(n)]
        found: dict[str, list[float]] = {c: [] for c in columns}
        for r in quantiles(long_form(df, columns), ["feature"], "x", levels).orderBy("feature", "level_ix").collect():
            found[r["feature"]].append(r["quantile"])
        return cls(levels, found)

    def rank(self, column: str) -> Column:
        """Rank in [0, 1] of a value, linear between quantiles; the middle of a flat stretch."""
        q = self.quantiles[column]
        if not q:
            return F.lit(None).cast("double")
        x, qs, ps = F.col(column).cast("double"), F.array(*[F.lit(float(v)) for v in q]), F.array(*[F.lit(v) for v in self.levels])
        below, upto = F.size(F.filter(qs, lambda v: v < x)), F.size(F.filter(qs, lambda v: v <= x))
        at = lambda a, i: F.element_at(a, i)
        inside = at(ps, below) + (x - at(qs, below)) / (at(qs, below + 1) - at(qs, below)) * (at(ps, below + 1) - at(ps, below))
        return F.when(x.isNull(), None).when(upto > below, (at(ps, below + 1) + at(ps, upto)) / 2).when(below == 0, 0.0).when(below == len(q), 1.0).otherwise(inside)

    def normal(self, column: str) -> Column:
        """The rank on the standard normal scale, clipped off 0 and 1; the inverse is interpolated in a fixed table."""
        steps = 2000
        table = F.array(*[F.lit(NormalDist().inv_cdf(min(max(i / steps, CLIP), 1 - CLIP))) for i in range(steps + 1)])
        p = F.least(F.greatest(self.rank(column), F.lit(CLIP)), F.lit(1 - CLIP)) * steps
        i = F.floor(p).cast("int")
        lo = F.element_at(table, i + 1)
        return lo + (p - i) * (F.element_at(table, F.least(i + 2, F.lit(steps + 1))) - lo)


def blended(map_: QuantileMap, column: str, weight: float = 0.9) -> Column:
    """weight x rank + (1 - weight) x score, clipped to [0, 1]."""
    clip = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(weight * map_.rank(column) + (1 - weight) * clip, F.lit(0.0)), F.lit(1.0))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def logit_shift(p: Column, threshold: float, slope: float = 1.0) -> Column:
    """sigma(slope (logit p - logit threshold)): the threshold goes to a half."""
    return sigmoid(slope * (logit(p) - logit(F.lit(threshold))))


def score_contract(p: Column) -> Column:
    """What a service returns: missing .5, within [0, 1], six places."""
    return F.round(F.least(F.greatest(F.coalesce(F.when(~F.isnan(p), p), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 6)


def search_threshold(candidates: DataFrame, objective: str = "objective", upper: str = "fpr_upper", most: float = 0.10, fallback: float | None = None) -> DataFrame:
    """threshold: of candidates whose upper bound of the false-positive rate is at most `most`, that with the best objective; else the fallback."""
    ok = candidates.where(F.col(upper) <= most).agg(F.max_by("threshold", F.struct(objective, -F.col("threshold"))).alias("threshold"))
    return ok.select(F.coalesce("threshold", F.lit(fallback)).alias("threshold"))
