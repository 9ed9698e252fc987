"""Running sums and exact quantiles over an order of all rows, without one task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with `<name>`, the sum of a column up to each row within its group in order, and `all_<name>`, that of the group.

    Rows are dealt to range partitions of (by, order), so a group may span many;
    each partition is summed from its own start and moved by the sums of the
    group's partitions before it, of which there is a row for each. Rows that
    are equal in `order` have sums in any order: make it total.
    """
    parts = checkpointed(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    own = parts.groupBy("__part", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(
        F.col("__part").alias("__p"),
        *[F.col(c).alias(f"__by_{c}") for c in by],
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums],
        *[F.sum(n).over(group).alias(f"all_{n}") for n in sums],
    )
    inside = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = parts.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(own, same)
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", "__p", *[f"__by_{c}" for c in by], *[f"__{n}" for n in sums])


def quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """(by, level_ix, quantile): linear quantiles of a column in each group, nulls and NaN left out. Values are counted before they are ranked."""
    x = F.col(value).cast("double")
    counts = df.select(*by, x.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ranked = running(counts, by, ["__v"], {"upto": "__n"})
    holds = lambda at: (F.col("upto") - F.col("__n") <= at) & (at < F.col("upto"))
    places = F.transform(F.array(*[F.lit(float(q)) for q in levels]), lambda q, i: F.struct(i.alias("level_ix"), ((F.col("all_upto") - 1).cast("double") * q).alias("place")))
    ends = F.filter(places, lambda p: holds(F.floor(p["place"])) | holds(F.ceil(p["place"])))  # a quantile lies between the values at two ranks
    found = ranked.select(*by, "__v", "upto", "__n", F.explode(ends).alias("e"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("__v")))
    low, high = at(F.floor("e.place")), at(F.ceil("e.place"))
    return found.groupBy(*by, F.col("e.level_ix").alias("level_ix")).agg((low + (high - low) * F.max(F.col("e.place") - F.floor("e.place"))).alias("quantile"))
