"""Mixing sources to target weights, with DataFrame functions only.

A budget of tokens goes down a tree domain - language - source in proportion to
weights, 0 or more. A node takes at most its tokens times the epochs allowed; what
it can't take goes to its siblings by their weights, and only what a whole
subtree can't take goes further up. Each source then takes whole epochs and,
of the next epoch's seeded order, the prefix that fills its budget to the token.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed

SEED = 17
#: Share of all tokens that is asked for, and how often a document may be used.
BUDGET_SHARE, MAX_EPOCHS = 0.6, 2
#: Target weights of the registered query, by level and name; names that aren't listed weigh 1.
TARGETS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "language": {"en": 5, "de": 3, "fr": 2}, "source": {"src3": 3, "src7": 2, "src11": 4, "src2": 0.5, "src5": 0}}
#: Documents of a leaf from which its slices are sliced again.
WIDE_LEAF = 1 << 24
#: Leaves up to which their plan, a short row for each, goes to all machines; beyond, it is joined by a shuffle.
FEW_LEAVES = 50_000
TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "language", "source_name")


def token_count(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def first_words(text: str, n: str) -> Column:
    """A text up to the end of its n-th word."""
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(F.col(text), ends), F.lit(1), F.col(n).cast("int")), "")


def domain_of(source: str, domains: int = 4) -> Column:
    """The default domain: one of `domains` (16 at most) by the source's name."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int"), F.lit(domains)).cast("string"))


def whole_weights(weights: Mapping[str, float] | None) -> tuple[dict[str, int], int]:
    """Weights of a level as whole numbers in the same proportion, and that of names that aren't listed."""
    exact = {name: Fraction(str(w)) for name, w in (weights or {}).items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError(f"weights are 0 or more: {weights}")
    of = math.lcm(1, *(w.denominator for w in exact.values()))
    return {name: int(w * of) for name, w in exact.items()}, of


def _weight(column: str, weights: Mapping[str, float] | None) -> Column:
    named, other = whole_weights(weights)
    out = F.lit(other).cast("long")
    for name, w in named.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Nodes (weight, cap, have = the parent's budget) with `budget`: shares by weight up to cap, the rest to siblings.

    Sorted by cap / weight the nodes that fill up are a prefix; the others share
    what is left by weight. A node without weight has a cap of 0 and gets
    nothing. Windows are over a parent's children, not documents.
    """
    ratio = F.try_divide(F.col("cap").cast("double"), F.col("weight"))
    by = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_first(), name)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(F.col("have") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum("weight").over(onward))
    nodes = nodes.withColumn("level", level).withColumn("full", (F.col("weight") == 0) | (F.col("level") >= ratio))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    budget = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), share) * F.col("weight")))
    return nodes.withColumn("share", share).withColumn("budget", budget).drop("level", "full", "share")


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Leaves (LEVELS, n_tokens, ...) with `budget` in tokens. What a node of weight 0 could hold counts for none of its ancestors."""
    weights = weights or {}
    able = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)
    up = lambda nodes, *by: nodes.groupBy(*by).agg(F.sum("cap").alias("cap"), F.sum("n").alias("n"))
    low = leaves.withColumn("weight", _weight("source_name", weights.get("source"))).withColumn("cap", F.col("n_tokens") * max_epochs).withColumn("cap", able)
    mid = up(low.withColumn("n", F.col("n_tokens")), "domain", "language").withColumn("weight", _weight("language", weights.get("language"))).withColumn("cap", able)
    top = up(mid, "domain").withColumn("weight", _weight("domain", weights.get("domain"))).withColumn("cap", able).withColumn("root", F.lit(0))
    have = F.sum("n").over(Window.partitionBy("root")) * F.lit(float(budget_share))
    top = fill(top.withColumn("have", have), ["root"], "domain")
    mid = fill(mid.join(top.select("domain", F.col("budget").alias("have")), "domain"), ["domain"], "language")
    low = fill(low.join(mid.select("domain", "language", F.col("budget").alias("have")), ["domain", "language"]), ["domain", "language"], "source_name")
    return low.select(*LEVELS, *[c for c in leaves.columns if c not in (*LEVELS, "cap")], F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    domain: Column | None = None,
    weights: Mapping[str, Mapping[str, float]] | None = None,  # by "domain", "language" and "source": name and weight, 1 for others
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """key, LEVELS, tokens, copies, partial_tokens of each document that is used; with `keep` also `row`, a struct of these columns of its own row.

    copies: how often the whole document is used. partial_tokens: the tokens of
    the one document of a leaf at which its prefix ends (0 elsewhere). Null
    language and source are a leaf of their own, "(none)"; documents without
    a token, null and empty texts among them, are never used. Repeated rows and
    null keys count as documents of their own. An empty table gives no row.
    Columns other than those named, whatever their names, are not read. Weights
    may be fractions; one of 0 gives no budget, and its share goes to siblings,
    then to those of ancestors; a negative one is a ValueError.

    A leaf may hold a third of all rows: its running total is taken in 4096
    slices of the seeded hash, and slices are offset by their aggregated sums;
    from WIDE_LEAF documents on each slice is parted into 4096 once more.
    """
    none = F.lit("(none)")
    named = docs.select(
        F.col(key).alias("__key"),
        (domain if domain is not None else domain_of(source)).alias("domain"),
        F.coalesce(F.col(lang).cast("string"), none).alias("language"),
        F.coalesce(F.col(source).cast("string"), none).alias("source_name"),
        token_count(text).alias("tokens"),
        *([F.struct(*keep).alias("row")] if keep else []),
    ).where("tokens > 0")
    whole, named = named, checkpointed(named.drop("row"))
    leaves = named.groupBy(*LEVELS).agg(F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    leaves = checkpointed(budgets(checkpointed(leaves), budget_share, max_epochs, weights))
    digits = F.when(F.col("n_docs") >= WIDE_LEAF, 6).otherwise(3)
    plan = leaves.select(*LEVELS, F.expr("budget div n_tokens").alias("epochs"), F.expr("budget % n_tokens").alias("rest"), digits.alias("digits"))
    if leaves.count() <= FEW_LEAVES:
        plan = F.broadcast(plan)

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(plan, list(LEVELS))
        rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("__key").cast("string"), F.lit(""))).cast("binary")))
        # dealt by slice: the join above may have left a leaf in one place
        return rows.withColumn("slice", F.substring("h", F.lit(1), F.col("digits"))).repartition(*LEVELS, "slice")

    seen = dealt(named)
    sums = seen.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("n"))
    sums = checkpointed(sums.withColumn("top", F.substring("slice", 1, 3)))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy(*LEVELS, "top").agg(F.sum("n").alias("n")).withColumn("base", before(LEVELS, "top")).drop("n")
    sums = sums.withColumn("own", before((*LEVELS, "top"), "slice")).join(tops, [*LEVELS, "top"]).select(*LEVELS, "slice", (F.col("base") + F.col("own")).alias("offset"))
    if keep:
        seen = dealt(whole)
    ties = [F.xxhash64("row")] if keep else []
    within = Window.partitionBy(*LEVELS, "slice").orderBy("h", "__key", "tokens", *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.withColumn("upto", F.sum("tokens").over(within)).join(sums, [*LEVELS, "slice"])
    end = F.col("offset") + F.col("upto")
    copies = (F.col("epochs") + F.when(end <= F.col("rest"), 1).otherwise(0)).cast("long")
    begin = end - F.col("tokens")
    partial = F.when((begin < F.col("rest")) & (end > F.col("rest")), F.col("rest") - begin).otherwise(0).cast("long")
    out = placed.select(F.col("__key").alias(key), *LEVELS, "tokens", copies.alias("copies"), partial.alias("partial_tokens"), *(["row"] if keep else []))
    return out.where("copies > 0 or partial_tokens > 0")


def oracle_sql(budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Mapping[str, Mapping[str, float]] | None = None) -> str:
    """The same in DuckDB's SQL over `documents`."""

    def able(src: str, column: str, level: str) -> str:
        named, other = whole_weights((weights or {}).get(level))
        weight = f"CASE {column} {' '.join(f"WHEN '{n}' THEN {w}" for n, w in named.items())} ELSE {other} END" if named else str(other)
        return f"SELECT * EXCLUDE (most), CASE WHEN weight > 0 THEN CAST(most AS BIGINT) ELSE 0 END AS cap FROM (SELECT *, {weight} AS weight FROM ({src}))"

    def filled(src: str, parent: str, name: str) -> str:
        ratio = "CAST(cap AS DOUBLE) / nullif(weight, 0)"
        return f"""
      SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), greatest(0.0, max(CASE WHEN NOT is_full THEN lvl END) OVER (PARTITION BY {parent})) * weight) END AS budget
      FROM (SELECT *, weight = 0 OR lvl >= {ratio} AS is_full FROM (
        SELECT *, (have - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY {ratio} NULLS FIRST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / nullif(sum(weight) OVER (PARTITION BY {parent} ORDER BY {ratio} NULLS FIRST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lvl FROM ({src})))"""

    low_w = able(f"SELECT *, n_tokens * {max_epochs} AS most FROM leaves", "source_name", "source")
    mid_w = able("SELECT domain, language, sum(cap) AS most, sum(n_tokens) AS n FROM low_w GROUP BY domain, language", "language", "language")
    top_w = able("SELECT domain, sum(cap) AS most, sum(n) AS n, 0 AS root FROM mid_w GROUP BY domain", "domain", "domain")
    top = filled(f"SELECT *, CAST(sum(n) OVER () AS DOUBLE) * {budget_share} AS have FROM top_w", "root", "domain")
    mid = filled("SELECT a.*, t.budget AS have FROM mid_w a JOIN top t USING (domain)", "domain", "language")
    low = filled("SELECT l.*, m.budget AS have FROM low_w l JOIN mid m USING (domain, language)", "domain, language", "source_name")
    levels = "domain, language, source_name"
    return f"""
WITH named AS (
  SELECT doc_id, 'd' || CAST(CAST('0x' || md5(coalesce(source, ''))[1:1] AS INTEGER) % 4 AS VARCHAR) AS domain, coalesce(lang, '(none)') AS language,
         coalesce(source, '(none)') AS source_name, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT {levels}, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM named WHERE tokens > 0 GROUP BY ALL),
low_w AS ({low_w}), mid_w AS ({mid_w}), top_w AS ({top_w}), top AS ({top}), mid AS ({mid}), low AS ({low}),
plan AS (SELECT {levels}, CAST(floor(budget + 1e-6) AS BIGINT) // n_tokens AS epochs, CAST(floor(budget + 1e-6) AS BIGINT) % n_tokens AS rest FROM low),
seen AS (SELECT *, md5('{seed}:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS h FROM named JOIN plan USING ({levels}) WHERE tokens > 0),
placed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY {levels} ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ends FROM seen),
used AS (SELECT doc_id, {levels}, tokens, epochs + CASE WHEN ends <= rest THEN 1 ELSE 0 END AS copies,
         CAST(CASE WHEN ends - tokens < rest AND ends > rest THEN rest - (ends - tokens) ELSE 0 END AS BIGINT) AS partial_tokens FROM placed)
SELECT * FROM used WHERE copies > 0 OR partial_tokens > 0"""
