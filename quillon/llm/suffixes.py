"""Exact repeats by enhanced suffix arrays and their common-prefix interval trees.

Every string of `length` bytes contains runs of GRAM bytes; the least hash among
them is its anchor, so equal strings have equal anchors wherever they stand.
Documents ask which anchors occur in two documents or more (packed.py). Around
those only, segments - stretches of strings with one anchor - go to the bucket
of the anchor. A bucket sorts the suffixes of its distinct segments, takes the
common prefixes of neighbours, and scans the tree of common-prefix intervals
from `length` up. An interval whose occurrences differ in the byte before them
is a maximal repeat; all its occurrences are returned, with the smallest key.

An anchor that very many documents share has its strings dealt one by one, by
their own hash, so no key gathers without bound. Equal segments of a block are
one entry with its smallest and largest key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import packed

LENGTH, GRAM = 50, 24
#: Strings of a segment at most; documents of an anchor from which its strings are dealt one by one.
RUN, HOT = 32, 20_000
STEP_BYTES = 1_000_000
#: Bytes of segments that are sorted together.
BUCKET_BYTES = 3_000_000
_NONE = np.iinfo(np.int64).max


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k bytes, by doubling."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    power, span = b.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while True:
        if k & span:
            if out is None:
                out, have = power, span
            else:
                n = len(power) - have
                out = out[:n] * np.uint64(pow(base, span, mask + 1)) + power[have : have + n]
                have += span
        if span * 2 > k:
            break
        power = power[:-span] * np.uint64(pow(base, span, mask + 1)) + power[span:]
        span *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Strings:
    """The strings of `length` bytes of some texts, as runs: consecutive strings of one text with one anchor.

    start: where the first string of each run starts; count: its strings; text, anchor: of each run.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH) -> None:
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.cumsum(sizes) - sizes
        n = len(self.bytes) - length + 1
        if n < 1:
            self.start = self.count = self.text = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        whole = owner[:n] == owner[length - 1 :]  # texts are parted by starts of strings that aren't whole
        least = _least(gram_hashes(self.bytes, GRAM), length - GRAM + 1)[:n]
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        stop = np.append(np.flatnonzero(new | ~whole), n)
        self.start = np.flatnonzero(new)
        self.count = stop[np.searchsorted(stop, self.start, side="right")] - self.start
        self.text = owner[self.start].astype(np.int64)
        anchor = least[self.start] * np.uint64(0x9E3779B97F4A7C15)  # minima are small: spread them
        self.anchor = anchor ^ (anchor >> np.uint64(32))


def strings(texts: list[str], length: int) -> list[tuple[int, Strings]]:
    """The strings of a block's texts in parts of bounded size, with the index of each part's first text."""
    out, part, start, size = [], [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > STEP_BYTES:
            out.append((start, Strings(part, length)))
            part, start, size = [], i, 0
        part.append(raw)
        size += len(raw)
    return [*out, (start, Strings(part, length))] if part else out


def _anchors(parts: list[tuple[int, Strings]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a block, and in how many of its texts each occurs."""
    found = []
    for _, s in parts:
        a, t = s.anchor, s.text
        order = np.lexsort((t, a))
        a, t = a[order], t[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
        found.append(a[keep])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # a text is whole in one part


def _segments(s: Strings, asked: np.ndarray, total: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and route of the segments of shared anchors. Hot anchors give a segment for each string."""
    if not len(s.start):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    docs = total[np.searchsorted(asked, s.anchor)]
    pick = docs >= 2
    n, hot, anchor = s.count[pick], (docs >= HOT)[pick], s.anchor[pick]
    width = np.where(hot, 1, RUN)
    parts = -(-n // width)
    of = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = s.start[pick][of] + k * width[of]
    end = start + np.minimum(width[of], n[of] - k * width[of]) - 1 + length
    route = anchor[of].copy()
    if hot.any():
        single = hot[of]
        whole = np.zeros(len(s.bytes), np.uint64)
        h = gram_hashes(s.bytes, length)
        whole[: len(h)] = h
        route[single] = whole[start[single]]
    return start, end, route


def _rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The stretches of data as rows of equal width, padded with zeros, as 8-byte words in byte order."""
    width = -(-int((end - start).max()) // 8) * 8
    padded = np.append(data, np.zeros(width, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, width)[start].view(">u8").astype(np.uint64)
    over = width - (end - start)  # bytes past the end of each row, at its right
    for j in range(width // 8):
        gone = np.clip(over - 8 * (width // 8 - 1 - j), 0, 8)
        if gone.any():
            words[:, j] = np.where(gone == 8, 0, (words[:, j] >> (8 * np.minimum(gone, 7)).astype(np.uint64)) << (8 * np.minimum(gone, 7)).astype(np.uint64))
    return words


def _distinct(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal ones are neighbours, and whether each in that order is new.

    Ordered by a hash, compared by content: rows whose hashes collide stay apart.
    """
    h = size.astype(np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    w, n = words[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]).any(1) | (n[1:] != n[:-1])
    return order, new


def maximal_repeats(data: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray, most: np.ndarray, length: int = LENGTH, alone: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Occurrences (segment, offset, size, smallest key, group) of the maximal repeats of `length` bytes or more.

    Segments are data[start:end]; least and most are the smallest and largest
    key that has each. Repeats of one segment with itself are no repeats unless
    its keys differ. A repeat's bytes may reach to a segment's edge only.
    Segments that are `alone` share no string with another; only their whole
    is entered.
    """
    count = end - start - length + 1
    if alone is not None:
        count = np.where(alone, 1, count)
    seg = np.repeat(np.arange(len(start)), count)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    at, size = start[seg] + offset, end[seg] - start[seg] - offset
    before = np.where(offset > 0, data[at - 1].astype(np.int64), -1 - seg)  # an edge differs from every byte
    words = _rows(data, at, end[seg])
    order = np.lexsort((size, *words.T[::-1]))  # the suffix array
    seg, offset, size, before, words = seg[order], offset[order], size[order], before[order], words[order]
    n = len(seg)
    # common prefixes of neighbours, in bytes
    diff = words[1:] ^ words[:-1]
    lcp = np.minimum(size[1:], size[:-1])
    some = diff != 0
    word = np.where(some.any(1), some.argmax(1), words.shape[1])
    hit = np.minimum(word, words.shape[1] - 1)
    x = diff[np.arange(n - 1), hit]
    lead = np.zeros(n - 1, np.int64)
    for shift in (32, 16, 8):
        zero = (x >> np.uint64(64 - shift)) == 0
        lead += np.where(zero, shift // 8, 0)
        x = np.where(zero, x << np.uint64(shift), x)
    lcp = np.minimum(lcp, np.where(some.any(1), word * 8 + np.minimum(lead, 7), size[1:]))
    left, right, depth = intervals(lcp, length)
    # single suffixes whose segment has several keys are repeats of their own, at the full size
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    own = np.flatnonzero((least < most)[seg] & (offset == 0))
    low, high = least[seg], most[seg]
    diverse = changes[right] > changes[left]
    left, right, depth = (np.concatenate((v[diverse], o)) for v, o in ((left, own), (right, own), (depth, size[own])))
    if not len(left):
        return (np.zeros(0, np.int64),) * 5
    width = right - left + 1
    group = np.repeat(np.arange(len(left)), width)
    member = np.arange(len(group)) - np.repeat(np.cumsum(width) - width, width) + left[group]
    heads = np.cumsum(width) - width
    smallest, largest = np.minimum.reduceat(low[member], heads), np.maximum.reduceat(high[member], heads)
    keep = (smallest < largest)[group]
    group, member = group[keep], member[keep]
    return seg[member], offset[member], depth[group], smallest[group], group


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common-prefix interval tree down to depth `least`: left, right (suffix ranks, inclusive) and depth of each node.

    A scan with a stack of open intervals: a smaller prefix closes the deeper
    ones. Only ranks at which the prefix changes are visited.
    """
    short = np.where(lcp < least, 0, lcp)
    change = np.flatnonzero(np.diff(short, prepend=0, append=0))
    value = np.append(short, 0)
    open_: list[tuple[int, int]] = []  # depth, left
    left, right, depth = [], [], []
    for i, d in zip(change.tolist(), value[change].tolist(), strict=True):
        start = i
        while open_ and open_[-1][0] > d:
            deep, start = open_.pop()
            left.append(start)
            right.append(i)
            depth.append(deep)
        if d and (not open_ or open_[-1][0] < d):
            open_.append((d, start))
    return np.array(left, np.int64), np.array(right, np.int64), np.array(depth, np.int64)


def _asked_segments(texts: list[str], replies: pd.DataFrame, length: int):
    """For each part of a block: its strings, segments, and for each segment its number among the block's distinct ones of its part."""
    parts = strings(texts, length)
    asked, _ = _anchors(parts)
    total = packed.aligned(replies, np.uint16)
    for first, s in parts:
        start, end, route = _segments(s, asked, total, length)
        if not len(start):
            continue
        text = np.searchsorted(s.text_start, start, side="right") - 1
        order, new = _distinct(_rows(s.bytes, start, end), end - start)
        number = np.empty(len(start), np.int64)
        number[order] = np.cumsum(new) - 1
        yield first, s, start, end, route, text, number


def _request_rows(block: int, texts: list[str], keys: np.ndarray, replies: pd.DataFrame, buckets: int, length: int) -> list[tuple]:
    rows = []
    for first, s, start, end, route, text, number in _asked_segments(texts, replies, length):
        n = int(number.max()) + 1
        least, most = np.full(n, _NONE), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, number, keys[first + text])
        np.maximum.at(most, number, keys[first + text])
        one = np.zeros(n, np.int64)
        one[number] = np.arange(len(start))
        bucket = (route[one] >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((np.arange(n), bucket))
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order].astype(np.int64)) != 0)))
        for a, b in zip(edges, np.append(edges[1:], n), strict=True):
            own = order[a:b]
            x, y = start[one[own]], end[one[own]]
            size = y - x
            flat = np.repeat(x - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows.append((int(bucket[order[a]]), block, first, packed.pack(own.astype(np.uint32)), packed.pack(size.astype(np.uint16)), packed.pack(route[one[own]].astype(np.uint32)), zstandard.compress(s.bytes[flat].tobytes(), 1), packed.pack(least[own]), packed.pack(most[own])))
    return rows


def _share(data: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray, most: np.ndarray, route: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Entry, offset, size and smallest key of the repeats among the entries `own` that lie in a larger key too."""
    start, end, least, most, route = start[own], end[own], least[own], most[own], route[own]
    order, new = _distinct(_rows(data, start, end), end - start)
    one = np.empty(len(own), np.int64)
    one[order] = np.cumsum(new) - 1
    rep = order[new]
    low, high = np.full(len(rep), _NONE), np.full(len(rep), np.iinfo(np.int64).min)
    np.minimum.at(low, one, least)
    np.maximum.at(high, one, most)
    _, at = np.unique(route[rep], return_inverse=True)
    lone = np.bincount(at)[at] == 1
    seg, offset, depth, smallest, _ = maximal_repeats(data, start[rep], end[rep], low, high, length, lone)
    by = np.argsort(seg, kind="stable")
    seg, offset, depth, smallest = seg[by], offset[by], depth[by], smallest[by]
    lo = np.searchsorted(seg, one)
    width = np.searchsorted(seg, one, side="right") - lo
    entry = np.repeat(np.arange(len(one)), width)
    k = np.arange(len(entry)) - np.repeat(np.cumsum(width) - width, width) + lo[entry]
    keep = smallest[k] < most[entry]
    entry, k = entry[keep], k[keep]
    return own[entry], offset[k], depth[k], smallest[k]


def _bucket_replies(part: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each asking part the spans of its segments that a smaller key also has: segment, offset, size, that key."""
    sizes = [packed.unpack(v, np.uint16).astype(np.int64) for v in part["sizes"]]
    numbers = [packed.unpack(v, np.uint32) for v in part["numbers"]]
    least, most = (np.concatenate([packed.unpack(v, np.int64) for v in part[c]]) for c in ("least", "most"))
    data = np.frombuffer(b"".join(map(zstandard.decompress, part["data"])), np.uint8)
    size = np.concatenate(sizes)
    end = np.cumsum(size)
    start = end - size
    route = np.concatenate([packed.unpack(v, np.uint32) for v in part["routes"]])
    shares = -(-len(data) // BUCKET_BYTES)  # equal strings have equal routes: a large bucket is done in shares
    got = [_share(data, start, end, least, most, route, own, length) for i in range(shares) if len(own := np.flatnonzero(route % shares == i))]
    entry, offset, depth, smallest = (np.concatenate(v) for v in zip(*got, strict=True))
    by = np.argsort(entry, kind="stable")
    entry, offset, depth, smallest = entry[by], offset[by], depth[by], smallest[by]
    number = np.concatenate(numbers)[entry]
    bounds = np.searchsorted(entry, np.concatenate(([0], np.cumsum([len(v) for v in sizes]))))
    rows = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if a < b:
            rows.append((part["block"].iloc[i], part["first"].iloc[i], packed.pack(number[a:b].astype(np.uint32)), packed.pack(offset[a:b].astype(np.uint16)), packed.pack(depth[a:b].astype(np.uint16)), packed.pack(smallest[a:b])))
    return pd.DataFrame(rows, columns=["block", "first", "numbers", "offsets", "sizes", "keys"])


def _removed(texts: list[str], keys: np.ndarray, replies: pd.DataFrame, found: pd.DataFrame, length: int) -> list[list[tuple[int, int]]]:
    """Maximal removed byte runs of each text of a block."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    by_part = {f: g for f, g in found.groupby("first")}
    for first, s, start, _, _, text, number in _asked_segments(texts, replies, length):
        if first not in by_part:
            continue
        got = by_part[first]
        num = np.concatenate([packed.unpack(v, np.uint32) for v in got["numbers"]]).astype(np.int64)
        off, size = (np.concatenate([packed.unpack(v, np.uint16) for v in got[c]]).astype(np.int64) for c in ("offsets", "sizes"))
        key = np.concatenate([packed.unpack(v, np.int64) for v in got["keys"]])
        by = np.argsort(num, kind="stable")
        num, off, size, key = num[by], off[by], size[by], key[by]
        lo, hi = np.searchsorted(num, number), np.searchsorted(num, number, side="right")
        width = hi - lo
        seg = np.repeat(np.arange(len(number)), width)
        k = np.arange(len(seg)) - np.repeat(np.cumsum(width) - width, width) + lo[seg]
        gone = key[k] < keys[first + text[seg]]
        a = start[seg[gone]] + off[k[gone]]
        mark = np.zeros(len(s.bytes) + 1, np.int64)
        np.add.at(mark, a, 1)
        np.add.at(mark, a + size[k[gone]], -1)
        covered = np.cumsum(mark[:-1]) > 0
        edge = np.ones(len(covered), bool)
        edge[1:] = covered[1:] != covered[:-1]
        edge[s.text_start[s.text_start < len(covered)]] = True
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(covered))
        pick = covered[heads]
        heads, tails = heads[pick], tails[pick]
        own = np.searchsorted(s.text_start, heads, side="right") - 1
        for t, x, y in zip(own.tolist(), heads.tolist(), tails.tolist(), strict=True):
            spans[first + t].append((x - int(s.text_start[t]), y - int(s.text_start[t])))
    return spans


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_bytes, spans (start, end of the maximal removed byte runs) and kept (the other bytes) of every row.

    A byte is removed where a string of `length` bytes covers it that also
    starts in a row with a smaller key. Null text counts as empty. Rows with a
    null key lose nothing and take nothing. Rows that share a key, repeated ones
    too, lose nothing to each other. An empty table gives no row; other columns,
    whatever their names, are not read. A very long text is held whole in one
    task, with some 60 bytes for each of its own.
    """
    plan = packed.size_up(docs, text, hashes_per_char=0.075)
    keyed = docs.where(F.col(key).isNotNull())
    blocks = packed.in_blocks(keyed.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", "text", plan)
    replies = packed.totals(packed.requests(blocks, plan, lambda texts: _anchors(strings(texts, length)), np.uint32), np.uint16, np.uint32, blocks=plan.blocks)
    buckets = max(64, plan.blocks)

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["key", "text"])  # alike in every pass
        rows = [] if left.empty else _request_rows(int(left["block"].iloc[0]), left["text"].tolist(), left["key"].to_numpy(), right, buckets, length)
        return pd.DataFrame(rows, columns=["bucket", "block", "first", "numbers", "sizes", "routes", "data", "least", "most"])

    segments = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(ask, "bucket int, block int, first int, numbers binary, sizes binary, routes binary, data binary, least binary, most binary")
    found = segments.groupBy("bucket").applyInPandas(lambda part: _bucket_replies(part, length), "block int, first int, numbers binary, offsets binary, sizes binary, keys binary")
    none = F.lit(None)
    heard = replies.select("block", "bucket", "totals", *[none.cast(t).alias(c) for c, t in (("first", "int"), ("numbers", "binary"), ("offsets", "binary"), ("sizes", "binary"), ("keys", "binary"))]).unionByName(
        found.select("block", none.cast("int").alias("bucket"), none.cast("binary").alias("totals"), "first", "numbers", "offsets", "sizes", "keys")
    )

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["key", "text"])
        texts = left["text"].tolist()
        told = right["bucket"].isna()
        spans = _removed(texts, left["key"].to_numpy(), right[~told], right[told], length)
        rows = []
        for k, t, gone in zip(left["key"].tolist(), texts, spans, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            edges = [0, *(x for s in gone for x in s), len(raw)]
            rows.append((k, len(raw), [{"start": a, "end": b} for a, b in gone], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        return pd.DataFrame(rows, columns=["key", "n_bytes", "spans", "kept"])

    done = blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInPandas(finish, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    loose = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"))
    loose = loose.select("key", F.length("kept").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), "kept")
    return done.unionByName(loose).withColumnRenamed("key", key)


def brute_force(rows: list[tuple[int, str]], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """Removed runs by key, the plain way, for tests (distinct keys)."""
    first: dict[bytes, int] = {}
    for k, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, k), k)
    out = {}
    for k, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        runs, i = [], 0
        while i < len(raw):
            if gone[i]:
                j = i
                while j < len(raw) and gone[j]:
                    j += 1
                runs.append((i, j))
                i = j
            else:
                i += 1
        out[k] = runs
    return out
