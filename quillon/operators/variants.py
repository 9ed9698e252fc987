"""Hands and reports as VARIANT: what a fixed schema loses - missing against null, keys at any depth, shapes not known before."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nesting that `flat_metrics` goes down.
DEPTH = 8


def seed_text(value: Column) -> Column:
    """What a VARIANT counts as in a hash seed: empty where the field is missing, `None` for null, `True` and `False`, else its text.

    Whole numbers are written as such, others with a point; objects and arrays
    count by their JSON.
    """
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    number = F.when(kind.startswith("DECIMAL"), F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".0")))).otherwise(plain)
    known = F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), number).otherwise(F.coalesce(plain, F.to_json(value)))
    return F.when(value.isNull(), F.lit("")).when(F.is_variant_null(value), F.lit("None")).otherwise(known)


def field(value: Column, path: str) -> Column:
    """The VARIANT at a path: SQL null where it is missing, a VARIANT null where it is null."""
    return F.try_variant_get(value, path, "variant")


def items(value: Column, path: str) -> Column:
    """array<variant> at a path; empty where there is no array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def drop_keys(text: Column, names: Sequence[str]) -> Column:
    """A JSON text without these keys at any depth, keys in the order they have; null where it is no JSON.

    No built-in takes a key out of a VARIANT, so texts go through Python in Arrow batches.
    """
    gone = frozenset(names)

    def cut(x: object) -> object:
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items() if k not in gone}
        return [cut(v) for v in x] if isinstance(x, list) else x

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(cut(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def leaves(df: DataFrame, keys: Sequence[str], value: str, depth: int = DEPTH) -> DataFrame:
    """keys, path (`a/b`), of (the VARIANT there), size: a row for each scalar and each array of a VARIANT object, whatever its shape.

    Arrays aren't gone into: `size` is how many they hold. Nulls have rows,
    empty objects none. Objects nested deeper than `depth` are an error, not lost.
    One pass and no shuffle: a level is a generator over what the one before gave,
    which what is no object goes through as it is.
    """
    inside = lambda v: F.try_variant_get(v, "$", "map<string,variant>")  # noqa: E731 - null for what is no object
    at = df.select(*keys, F.lit("").alias("__at"), F.col(value).alias("__v"))
    for level in range(depth + 1):
        found = at.withColumn("__m", inside(F.col("__v")))
        found = found.select(*keys, "__at", "__v", F.col("__m").isNotNull().alias("__o"), F.explode_outer("__m").alias("__k", "__e"))
        found = found.where("not __o or __k is not null" if level else "__k is not null")  # the first level is of objects only
        path = F.concat("__at", F.lit("/" if level else ""), F.col("__k"))
        at = found.select(*keys, F.when(F.col("__o"), path).otherwise(F.col("__at")).alias("__at"), F.when(F.col("__o"), F.col("__e")).otherwise(F.col("__v")).alias("__v"))
    deeper = F.raise_error(F.concat(F.lit(f"nested deeper than {depth}: "), "__at")).cast("variant")
    every = at.select(*keys, F.col("__at").alias("path"), F.when(inside(F.col("__v")).isNotNull(), deeper).otherwise(F.col("__v")).alias("of"))
    return every.withColumn("size", F.size(F.try_variant_get("of", "$", "array<variant>"))).withColumn("size", F.when(F.col("size") >= 0, F.col("size")))


def flat_metrics(df: DataFrame, keys: Sequence[str], value: str, depth: int = DEPTH) -> DataFrame:
    """keys, path, metric double: numbers, booleans as 0 and 1, and of each array `<path>_count`, its length.

    Texts, nulls and what isn't an object have no row; keys may differ from row to row.
    """
    every = leaves(df, keys, value, depth)
    kind = F.schema_of_variant("of")
    flag = F.try_variant_get("of", "$", "boolean").cast("int").cast("double")
    number = F.when(kind == "BOOLEAN", flag).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("of", "$", "double"))
    metric = F.coalesce(F.col("size").cast("double"), number)
    path = F.when(F.col("size").isNotNull(), F.concat("path", F.lit("_count"))).otherwise(F.col("path"))
    return every.select(*keys, path.alias("path"), metric.alias("metric")).where("metric is not null")
