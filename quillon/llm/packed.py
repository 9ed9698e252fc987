"""Request and reply between blocks of documents and buckets of hashes, in packed columns.

Counting and looking up hundreds of hashes for each document costs more as rows
than as arrays. So documents are dealt into blocks by a hash of key and text; a
block sends each bucket (the high part of a hash) one row with a packed array of
its distinct hashes and their counts; a bucket adds up over all blocks and sends
each block one row back, aligned with what it asked. This is a shuffle join of
a count table, partitioned by hash, with the hashes of documents; a hash that
is everywhere costs one entry a block, however often it occurs.

Blocks and buckets are bounded, and their numbers follow the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialised

#: Characters of text in a block; hashes in a bucket, about.
BLOCK_CHARS, BUCKET_HASHES = 3_000_000, 1_000_000
#: Blocks whose rows for one bucket meet in one task.
MOST_BLOCKS = 8192


@dataclass(frozen=True)
class Plan:
    """How many blocks and buckets a corpus gets."""

    blocks: int
    buckets: int


def size_up(docs: DataFrame, text: str, hashes_per_char: float) -> Plan:
    """Blocks and buckets for a corpus, from its characters in all."""
    chars = docs.agg(F.sum(F.length(text))).head()[0] or 0
    return Plan(max(16, -(-chars // BLOCK_CHARS)), max(64, int(chars * hashes_per_char / BUCKET_HASHES)))


def in_blocks(docs: DataFrame, key: str, text: str, plan: Plan) -> DataFrame:
    """block, key, text. The block follows from key and text alone, so a rerun deals alike and no null or repeated key is hot."""
    block = F.pmod(F.xxhash64(F.col(key), F.xxhash64(F.col(text))), F.lit(plan.blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def bucket_width(buckets: int) -> int:
    """How many hash values a bucket takes."""
    return (1 << 64) // buckets + 1


def pack(values: np.ndarray) -> bytes:
    """Bytes by plane: the high bytes of sorted hashes and of small counts are runs that the shuffle compresses."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def requests(blocks: DataFrame, plan: Plan, hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: type = np.uint64, counted: type = np.uint32) -> DataFrame:
    """bucket, block, hashes, counts. `hashes` gets a block's texts and returns its distinct hashes, sorted, and a count for each.

    kind: uint64 sends whole hashes, for counts; uint32 the 32 bits that tell
    most within a bucket, for filters whose hits are tested again.
    counted: counts are sent as this, at most its largest. A block has a row for
    each bucket that it has hashes of, and visits no other.
    """
    width = bucket_width(plan.buckets)
    shift = np.uint64(max(0, width.bit_length() - 32))

    def rows(block: int, h: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        bucket = h // np.uint64(width)
        own, start = np.unique(bucket, return_index=True)
        sent = h if kind == np.uint64 else ((h - bucket * np.uint64(width)) >> shift).astype(kind)
        counts = np.minimum(n, min(np.iinfo(counted).max, np.iinfo(np.int64).max)).astype(counted)
        ends = [*start[1:].tolist(), len(h)][: len(own)]
        made = [(i, block, pack(sent[a:b]), pack(counts[a:b])) for i, a, b in zip(own.tolist(), start.tolist(), ends, strict=True)]
        return pd.DataFrame(made, columns=["bucket", "block", "hashes", "counts"])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return rows(key[0], *hashes(part["text"].tolist()))

    return blocks.groupBy("block").applyInPandas(run, "bucket int, block int, hashes binary, counts binary")


def _joined(part: pd.DataFrame, hashes: type, counted: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows of hashes; its distinct hashes in order, where each entry is among them, and their summed counts."""
    own = [unpack(x, hashes) for x in part["hashes"]]
    counts = np.concatenate([unpack(x, counted) for x in part["counts"]]).astype(np.uint64)
    distinct, at = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, at, counts)
    return own, distinct, at, total


def _split(values: np.ndarray, own: list[np.ndarray]) -> list[bytes]:
    ends = np.cumsum([len(x) for x in own]).tolist()
    return [pack(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def totals(asked: DataFrame, kind: type = np.uint32, hashes: type = np.uint64, counted: type = np.uint32, blocks: int = 0) -> DataFrame:
    """block, bucket, totals: for each hash asked (sent as `hashes`, counts as `counted`) its sum over all blocks, at most the largest of `kind`.

    blocks: how many blocks there are. A hash that is everywhere brings its
    bucket a row from each block; from MOST_BLOCKS on they are added up, and
    answered, over a tree of groups of at most that many.
    """
    top = np.uint64(np.iinfo(kind).max)
    if blocks > MOST_BLOCKS:
        return _tree_totals(asked, kind, hashes, counted, blocks)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own, _, at, total = _joined(part, hashes, counted)
        return pd.DataFrame({"block": part["block"], "bucket": key[0], "totals": _split(np.minimum(total, top).astype(kind)[at], own)})

    return asked.groupBy("bucket").applyInPandas(run, "block int, bucket int, totals binary")


def _tree_totals(asked: DataFrame, kind: type, hashes: type, counted: type, blocks: int) -> DataFrame:
    """As totals: sums go up a tree whose leaves are blocks, level by level, and the answers come down again."""
    top, node = np.uint64(np.iinfo(kind).max), "bucket int, block int, hashes binary, counts binary"
    parent = F.expr(f"block div {MOST_BLOCKS}")
    levels, counts = [materialised(asked)], counted

    def adder(counts: type) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            _, distinct, _, total = _joined(part, hashes, counts)
            return pd.DataFrame({"bucket": [key[0]], "block": [key[1]], "hashes": [pack(distinct)], "counts": [pack(total)]})

        return up

    while blocks > 1:
        levels.append(materialised(levels[-1].groupBy("bucket", parent.cast("int").alias("block")).applyInPandas(adder(counts), node)))
        blocks, counts = -(-blocks // MOST_BLOCKS), np.uint64

    def rooted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["counts"] = [pack(np.minimum(unpack(x, np.uint64), top).astype(kind)) for x in p["counts"]]
            yield p

    def down(key: tuple, above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        known, total = unpack(above["hashes"].iloc[0], hashes), unpack(above["counts"].iloc[0], kind)
        own = [unpack(x, hashes) for x in below["hashes"]]
        found = total[np.searchsorted(known, np.concatenate(own))]
        return pd.DataFrame({"bucket": key[0], "block": below["block"], "hashes": below["hashes"], "counts": _split(found, own)})

    known = levels.pop().mapInPandas(rooted, node)
    while levels:
        below = levels.pop().withColumn("up", parent.cast("int"))
        known = known.withColumn("up", F.col("block")).groupBy("bucket", "up").cogroup(below.groupBy("bucket", "up")).applyInPandas(down, node)
    return known.select("block", "bucket", F.col("counts").alias("totals"))


def aligned(replies: pd.DataFrame, kind: type = np.uint32) -> np.ndarray:
    """The totals of a block in the order of its sorted hashes."""
    if replies.empty:
        return np.zeros(0, kind)
    order = np.argsort(replies["bucket"].to_numpy(), kind="stable")
    return np.concatenate([unpack(replies["totals"].iloc[i], kind) for i in order])
