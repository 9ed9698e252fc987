"""SQL building blocks. A Dialect writes the few functions whose names differ between engines."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

STREETS = ("preflop", "flop", "turn", "river")
BLIND = "('small_blind', 'big_blind', 'ante')"
AGG = "('bet', 'raise', 'all_in')"
RAISE = "('raise', 'all_in')"
VOLUNTARY = "('call', 'bet', 'raise', 'all_in')"
#: Windows, joins and groupings of a plan without exchanges, about: a task holds the buffers of all of them at a time.
PLAN_OPERATORS = 16
#: Groups of parts that are written at a time.
WRITERS = 4


@dataclass(frozen=True)
class Dialect:
    """Function names of an engine."""

    name: str

    def rint(self, x: str) -> str:
        """Nearest whole number, ties to even."""
        return f"rint({x})" if self.name == "spark" else f"round_even({x}, 0)"

    def byte_at(self, text: str, i: int) -> str:
        """Byte i of the SHA-256 of a text as a number."""
        at = 2 * i + 1
        if self.name == "spark":
            return f"CAST(conv(substring(sha2({text}, 256), {at}, 2), 16, 10) AS INT)"
        return f"CAST(concat('0x', substring(sha256({text}), {at}, 2)) AS INT)"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.name == "spark" else f"sha256({text})"

    def sequence_key(self, value: str, order: str) -> str:
        """The values of a group in order, as one text."""
        if self.name == "spark":
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, CAST({value} AS STRING) AS v))), x -> x.v), '>')"
        return f"string_agg(CAST({value} AS VARCHAR), '>' ORDER BY {order})"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def div(a: str, b: str) -> str:
    """a / b as doubles; null where b is 0."""
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def share(cond: str) -> str:
    """Share of a group's rows that satisfy a condition; rows where it is null don't count."""
    return f"avg(CAST(({cond}) AS INT))"


def count_if(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def quantile(x: str, q: float) -> str:
    """Linear quantile, nulls left out."""
    return f"percentile_cont({q}) WITHIN GROUP (ORDER BY {x})"


def cv(x: str, cond: str = "TRUE") -> str:
    """Population standard deviation over mean; null for under two values or a mean of 0."""
    v = f"CASE WHEN {cond} THEN {x} END"
    return f"CASE WHEN count({v}) >= 2 THEN stddev_pop({v}) / nullif(avg({v}), 0) END"


def near(x: str, targets: tuple[float, ...], tolerance: float) -> str:
    return "(" + " OR ".join(f"abs({x} - {t}) < {tolerance}" for t in targets) + ")"


@dataclass
class Flow:
    """Named steps (CTEs) over input tables, and the last select."""

    steps: list[tuple[str, str]] = field(default_factory=list)
    last: str = ""
    kept: set[str] = field(default_factory=set)

    def step(self, name: str, sql: str, keep: bool = False) -> Flow:
        """keep: many steps read this one, so it is worth writing down where `frame` is given a way to."""
        self.steps.append((name, sql))
        if keep:
            self.kept.add(name)
        return self

    def needed(self) -> list[tuple[str, str]]:
        """The steps that the last select reads, by way of others or not."""
        known, want = dict(self.steps), []
        asks = lambda sql: [n for n in known if re.search(rf"(FROM|JOIN) {n}\b", sql)]
        rest = asks(self.last)
        while rest:
            name = rest.pop()
            if name not in want:
                want.append(name)
                rest += asks(known[name])
        return [(n, sql) for n, sql in self.steps if n in want]

    def operators(self, sql: str) -> int:
        """Windows, joins and groupings that a select brings into a plan, those of the steps it reads included, each as often as it is read."""
        known = dict(self.steps)
        read = [n for n in re.findall(r"(?:FROM|JOIN) (\w+)\b", sql) if n in known]
        return len(re.findall(r"\b(?:OVER|JOIN|GROUP BY|DISTINCT|UNION)\b", sql)) + sum(self.operators(known[n]) for n in read)

    def batches(self, key: str, most: int = PLAN_OPERATORS) -> list[list[str]]:
        """The steps that the last select joins by `key`, in groups of about `most` operators at most; none if all of it is within."""
        if self.operators(self.last) <= most:
            return []
        known, out, room = dict(self.steps), [], 0
        for name in re.findall(rf"LEFT JOIN (\w+) ON \1\.{key} = ", self.last):
            n = self.operators(known[name]) + 1
            if n > room:
                out.append([])
                room = most
            out[-1].append(name)
            room -= n
        return out

    def entropy(self, name: str, source: str, key: str, by: str = "chunk_id", kind: str = "smoothed", where: str = "TRUE") -> Flow:
        """Step `name`: by, h (entropy of `key` within a group), total, top (largest share), top3, kinds.

        kind: smoothed = log2 with 1e-12 added, plain = log2, even = natural log
        over that of the number of kinds (0 for one kind).
        """
        self.step(f"{name}_n", f"SELECT {by}, {key} AS k, count(*) AS c FROM {source} WHERE {where} GROUP BY {by}, {key}")
        self.step(f"{name}_t", f"SELECT *, sum(c) OVER (PARTITION BY {by}) AS total, row_number() OVER (PARTITION BY {by} ORDER BY c DESC, k) AS r FROM {name}_n")
        p = "(CAST(c AS DOUBLE) / total)"
        h = {"smoothed": f"-sum({p} * log2({p} + 1e-12))", "plain": f"-sum({p} * log2({p}))", "even": f"CASE WHEN count(*) <= 1 THEN CAST(0 AS DOUBLE) ELSE -sum({p} * ln({p} + 1e-12)) / ln(CAST(count(*) AS DOUBLE)) END"}[kind]
        return self.step(name, f"SELECT {by}, {h} AS h, max(total) AS total, max({p}) AS top, sum(CASE WHEN r <= 3 THEN {p} END) AS top3, count(*) AS kinds FROM {name}_t GROUP BY {by}")

    def text(self, inputs: list[tuple[str, str]] = ()) -> str:
        return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in [*inputs, *self.steps]) + "\n" + self.last

    def frame(self, spark: SparkSession, inputs: list[tuple[str, str]] = (), write: Callable[[DataFrame], DataFrame] | None = None, key: str = "chunk_id", **tables: DataFrame) -> DataFrame:
        """Runs over DataFrames: each table's name in braces inside the first inputs, or a step of its own.

        write: writes a step down and reads it back; steps that are kept and needed are then worked out once. Where the
        last select is still wider than a task should hold, the steps that it joins by `key` are written in groups first.
        """
        if write:
            needed, rest = self.needed(), []
            for name, sql in needed:
                if name in self.kept:
                    own = Flow([*rest, (name, sql)], f"SELECT * FROM {name}")
                    tables[name] = write(Flow(own.needed(), own.last).frame(spark, inputs, **tables))
                else:
                    rest.append((name, sql))
            flow = Flow(rest, self.last)
            groups = flow.batches(key)
            base = re.search(r" FROM (\w+) LEFT JOIN ", self.last)[1] if groups else ""

            def written(group: list[str]) -> DataFrame:
                last = f"SELECT {base}.{key}, " + ", ".join(f"struct({n}.*) AS {n}" for n in group) + f" FROM {base} " + " ".join(f"LEFT JOIN {n} ON {n}.{key} = {base}.{key}" for n in group)
                own = Flow(rest, last)
                return write(Flow(own.needed(), last).frame(spark, inputs, **tables))

            if groups:
                with ThreadPoolExecutor(WRITERS) as pool:
                    tables |= {f"written_{i}": t for i, t in enumerate(pool.map(written, groups))}
                joins = [f"LEFT JOIN written_{i} ON written_{i}.{key} = {base}.{key}" for i in range(len(groups))]  # a part is a struct of its group's table
                flow = Flow(rest, " ".join([self.last.partition(" LEFT JOIN ")[0], *joins]))
                flow = Flow(flow.needed(), flow.last)
            return flow.frame(spark, inputs, **tables)
        own = [(name, f"SELECT * FROM {{{name}}}") for name in tables]
        return spark.sql(Flow([*own, *inputs, *self.steps], self.last).text(), **tables)


def joined(base: str, parts: list[str], columns: dict[str, str], key: str = "chunk_id", digits: int | None = None, only: tuple[str, ...] = ()) -> str:
    """Select `columns` (those in `only`, if given) from base and the parts they need, each with a row at most for base's key."""
    if only:
        columns = {c: columns[c] for c in only}
    parts = [p for p in parts if any(f"{p}." in e for e in columns.values())]
    # means of whole cents often end on a 5 just after the last place: moved off it, so that engines round alike
    wrap = (lambda e: e) if digits is None else (lambda e: f"round({e} + 1e-{digits + 4}, {digits}) + 0")
    return f"SELECT {base}.{key}, " + ", ".join(f"{wrap(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in columns.items()) + f" FROM {base} " + " ".join(f"LEFT JOIN {p} ON {p}.{key} = {base}.{key}" for p in parts)
