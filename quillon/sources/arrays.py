"""Elements of JSON arrays of any size: a file is read in byte ranges by many tasks.

Where a range starts says nothing about whether it starts inside a string or how
deep in brackets. So each range is first read for what it does to both: how many
quotes it has, and how it changes the depth if it starts outside a string and if
it starts inside one. These compose: a running sum over a file's ranges, a row
for each, tells every range the state that it starts in. In a second reading
each range then cuts out its elements; one that goes over the edge of a range is
put together from its parts.

Spark's text reader deals out the ranges, on any store, with the closing brace
as the line separator; compressed files are one range. A backslash escapes the
next character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed, materialised

#: Ranges whose states, a short row each, go to all tasks; beyond, lines are dealt by range.
FEW_RANGES = 200_000
_CLOSE = {"[": "]", "{": "}"}
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_MARK = _STEP != 0
_MARK[[ord('"'), ord("\\")]] = True
#: What a piece is: an element, or the part of one that begins, goes on or ends in a range.
WHOLE, BEGINS, ON, ENDS = 0, 1, 2, 3


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of quotes that aren't escaped and of brackets: places, steps of depth (0 for a quote), and whether the quotes before them are odd."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[data])
    kind = data[at]
    slashes = at[kind == ord("\\")]
    if len(slashes):
        first = np.r_[True, np.diff(slashes) != 1]
        last = np.r_[first[1:], True]
        odd = (slashes[last] - slashes[first]) % 2 == 0
        gone = (kind == ord("\\")) | ((kind == ord('"')) & np.isin(at, slashes[last][odd] + 1))
        at, kind = at[~gone], kind[~gone]
    step = _STEP[kind].astype(np.int64)
    quote = step == 0
    return at, step, ((np.cumsum(quote) - quote) & 1).astype(bool)


class Cutter:
    """Cuts elements out of the text of a range, which may come in parts."""

    def __init__(self, in_string: bool, depth: int, level: int, opens: str) -> None:
        self.in_string, self.depth, self.level, self.opens, self.closes = in_string, depth, level, ord(opens), ord(_CLOSE[opens])
        self.held: list[bytes] = []
        self.kind = ON if depth > level else None  # what is being read when a part ends: nothing, an element of this range, or what another began

    def feed(self, text: bytes) -> Iterator[tuple[int, bytes | None]]:
        """(kind, text) of what ends here; no text where the closing bracket is of the wrong kind."""
        at, step, odd = marks(text)
        live = (step != 0) & (odd == self.in_string)
        place, step, quotes = at[live], step[live], int((step == 0).sum())
        after = self.depth + np.cumsum(step)
        ends = place[(after == self.level) & (step < 0)]
        starts = place[(after - step == self.level) & (np.frombuffer(text, np.uint8)[place] == self.opens)]
        self.in_string ^= bool(quotes & 1)
        self.depth = int(after[-1]) if len(after) else self.depth
        if self.kind is not None:
            if not len(ends):
                self.held.append(text)
                return
            end = int(ends[0])
            whole = b"".join([*self.held, text[: end + 1]])
            yield (ENDS if self.kind == ON else WHOLE), (whole if text[end] == self.closes else None)
            self.kind, self.held, starts = None, [], starts[starts > end]
        for start, n in zip(starts.tolist(), np.searchsorted(ends, starts).tolist(), strict=True):
            if n < len(ends):
                end = int(ends[n])
                yield WHOLE, (text[start : end + 1] if text[end] == self.closes else None)
            else:
                self.kind, self.held = BEGINS, [text[start:]]

    def rest(self) -> Iterator[tuple[int, bytes]]:
        """What the range leaves open."""
        if self.kind is not None:
            yield self.kind, b"".join(self.held)


def is_json(text: bytes | str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, bytes]]:
    """(key values, text) of neighbouring lines of a range; each line gets the brace back at which it was cut."""
    if not batch.num_rows:
        return
    columns, n = [batch.column(k) for k in keys], batch.num_rows
    texts = batch.column("value").cast(pa.binary())
    other = np.zeros(n - 1, bool)
    for c in columns:
        other |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        run = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), texts.slice(a, b - a))
        yield tuple(c[a].as_py() for c in columns), pc.binary_join(run, pa.scalar(b"}"))[0].as_py() + b"}"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, range (the byte a range starts at), value: text between closing braces, in order within a range."""
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), "value")


def states(rows: DataFrame) -> DataFrame:
    """path, range, in_string, depth, last: the state each range starts in, and whether it is its file's last."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for key, text in _runs(batch, ["path", "range"]):
                _, step, odd = marks(text)
                own = found.setdefault(key, [0, 0, 0])
                inside, outside = int(step[odd].sum()), int(step[~odd].sum())
                if own[0] & 1:  # the range's earlier lines end in the other state than they began
                    inside, outside = outside, inside
                own[0], own[1], own[2] = own[0] + int((step == 0).sum()), own[1] + outside, own[2] + inside
        made = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=["path", "range", "quotes", "outside", "inside"]).astype({"range": "int64", "quotes": "int64", "outside": "int64", "inside": "int64"}), preserve_index=False)

    each = rows.mapInArrow(read, "path string, range long, quotes long, outside long, inside long")
    each = each.groupBy("path", "range").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])
    order = Window.partitionBy("path").orderBy("range")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = each.withColumn("in_string", before("quotes") % 2 == 1)
    moved = odd.withColumn("by", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    return moved.select("path", "range", "in_string", before("by").alias("depth"), F.lead("range").over(order).isNull().alias("last"))


def pieces(rows: DataFrame, inside: str, opens: str, few: int = FEW_RANGES) -> DataFrame:
    """path, range, ix, kind, value: elements that are JSON, numbered within their range, and parts of elements that aren't in one range."""
    state = checkpointed(states(rows))
    if state.count() <= few:
        known = rows.join(F.broadcast(state), ["path", "range"])  # keeps the order of lines
    else:
        known = rows.withColumn("n", F.monotonically_increasing_id()).join(state, ["path", "range"]).sortWithinPartitions("path", "range", "n").drop("n")
    keys = ["path", "range", "in_string", "depth", "last"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, waiting, n = None, None, b"", 0

        def rows_of(found: Iterator[tuple[int, bytes | None]]) -> Iterator[tuple]:
            nonlocal n
            for kind, text in found:
                if kind == WHOLE:
                    if text is not None and is_json(text):
                        yield (*key[:2], n, kind, text.decode())
                        n += 1
                else:
                    yield (*key[:2], -1, kind, None if text is None else text.decode(errors="replace"))

        def ended() -> Iterator[tuple]:
            if cutter is not None:
                # the last line of a file has no brace of its own, or its last bracket, which closes no element
                yield from rows_of(cutter.feed(waiting[:-1] if key[4] else waiting))
                yield from rows_of(cutter.rest())

        def made() -> Iterator[tuple]:
            nonlocal key, cutter, waiting, n
            for batch in batches:
                for own, text in _runs(batch, keys):
                    if own != key:
                        yield from ended()
                        key, n = own, 0
                        cutter = Cutter(own[2], own[3], len(inside), opens)
                    else:
                        yield from rows_of(cutter.feed(waiting))
                    waiting = text
            yield from ended()

        held: list[tuple] = []
        size = 0
        for row in made():
            held.append(row)
            size += len(row[4] or "")
            if len(held) == 1000 or size > 1 << 24:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    return known.select(*keys, "value").mapInArrow(cut, "path string, range long, ix long, kind int, value string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["path", "range", "ix", "kind", "value"])


def stitched(parts: DataFrame) -> DataFrame:
    """path, range, value: elements over the edges of ranges that are JSON, under the range that they begin in."""
    turn = F.when(F.col("kind") == BEGINS, 1).otherwise(0)
    order = Window.partitionBy("path").orderBy("range", turn)
    own = parts.select("path", "range", "kind").withColumn("of", F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("path", "of").orderBy("range", F.desc(turn)).rowsBetween(Window.unboundedPreceding, -1)
    own = own.where("of > 0").withColumn("closed", F.coalesce(F.sum((F.col("kind") == ENDS).cast("int")).over(before), F.lit(0))).where("closed = 0")
    every = parts.join(own.select("path", "range", "kind", "of"), ["path", "range", "kind"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "value"))), lambda x: x["value"]), "")
    whole = every.groupBy("path", "of").agg(F.min("range").alias("range"), text.alias("value"), F.max("kind").alias("most"), F.bool_and(F.col("value").isNotNull()).alias("sound"))
    whole = whole.where((F.col("most") == ENDS) & F.col("sound")).select("path", "range", "value")

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[f["value"].map(is_json).astype(bool)]

    return whole.mapInPandas(kept, "path string, range long, value string")


def elements(spark: SparkSession, path: str | list[str], inside: str, opens: str) -> DataFrame:
    """file, pos, value: the JSON texts of the elements that open with `opens` within brackets `inside` (outermost first), numbered in order.

    An element ends where the depth is again what it was before it; what isn't
    JSON then is left out. So a broken element costs itself and what comes until
    the brackets and quotes are right again: one without its closing bracket
    takes the next ones with it until the depth is, one with an open quote turns
    strings inside out up to the next stray quote. A file that breaks off loses
    its last element. Elements are held whole, files are not.
    """
    found = materialised(pieces(lines(spark, path), inside, opens))
    own = found.where(F.col("kind") == WHOLE).select("path", "range", "ix", "value")
    across = checkpointed(stitched(found.where(F.col("kind") != WHOLE)))
    counts = own.select("path", "range").unionByName(across.select("path", "range")).groupBy("path", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = checkpointed(counts.select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"))
    base = F.broadcast(base) if base.count() <= FEW_RANGES else base  # elements stay where they are
    last = F.coalesce("ix", F.col("n") - 1)  # what begins in a range and ends in another is its last
    every = own.unionByName(across.withColumn("ix", F.lit(None).cast("long"))).join(base, ["path", "range"])
    return every.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("base") + last).alias("pos"), "value")
