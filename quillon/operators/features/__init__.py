"""Feature sets over hands, players and actions: a row for each chunk, a column for each feature.

A set is a function of a dialect and returns a Flow over the tables `hand`,
`play` and `act` (see quillon.operators.longform). Sets are computed each on its
own and joined on chunk_id, so a set that isn't asked for costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from quillon.functions.sql import SPARK, Flow
from quillon.operators.features import actions, context, hero, perhand, temporal
from quillon.operators.longform import HandTables
from quillon.session import bucketed

#: Set name: prefix of its columns, builder.
REGISTRY = {
    "actions": ("", actions.flow),
    "temporal": ("new_", temporal.flow),
    "context": ("new2_", context.flow),
    "perhand": ("new3_", perhand.flow),
    "hero": ("new4_", hero.flow),
}


def compute(tables: HandTables, sets: Iterable[str] = tuple(REGISTRY)) -> DataFrame:
    """chunk_id and the features of all `sets`, unrounded. Undefined: null (0 in the sets perhand and hero)."""
    out, tables = None, tables.bound()
    for name in sets:
        prefix, build = REGISTRY[name]
        one = run(build(SPARK), tables)
        one = one.select("chunk_id", *[one[c].alias(prefix + c) for c in one.columns if c != "chunk_id"])
        out = one if out is None else out.join(one, "chunk_id", "full")
    if out is None:
        raise ValueError("no feature set is asked for")
    return out


def run(flow: Flow, tables: HandTables) -> DataFrame:
    """A set over tables in buckets; what many of its steps read is written in buckets too. Nothing is shuffled by chunk_id again."""
    return flow.frame(tables.hand.sparkSession, write=lambda df: bucketed(df, "chunk_id", tables.buckets), hand=tables.hand, play=tables.play, act=tables.act)


def set_of(column: str) -> str:
    """The set that a column belongs to, by its longest prefix."""
    return max((p, n) for n, (p, _) in REGISTRY.items() if column.startswith(p))[1]
