"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within `bits` differing bits agree wholly in one of bits+1 bands,
so each distinct fingerprint goes to one bucket for each band. In a bucket the
fingerprints are sorted by Gray rank and factored into a tree: a node holds the
bits that its group shares under the masks of the levels so far. Pairs of nodes
are walked from the top; differences add up level by level and a pair of whole
groups is dropped as soon as they exceed the limit, or once both groups are
known to be one component. A bucket returns a spanning star of what it links,
never its pairs; components of all buckets' stars are joined by min-label
rounds over DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.batches import map_texts
from quillon.llm.components import min_labels
from quillon.session import checkpointed, materialised

SEED = 42
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` lower-cased words, repeats included; of the whole sequence if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest; short sums stay in bytes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3, words: int = 1) -> np.ndarray:
    """SimHash of 64 x words bits: a bit is set if it is in over half of the hashes; all zero if the text has no word.

    The second and further words come from the same hashes, mixed anew.
    """
    return _simhash(shingle_hashes(text, width), words)


def _simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for any length
        h = hashes[at : at + (1 << 15)]
        for w in range(words):
            ones[w] += _bit_counts(h)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key, fp long (the 64 bits, signed). Null and empty texts have fingerprint zero."""

    def run(texts: list) -> list[list]:
        return [np.concatenate([fingerprint(t, width) for t in texts]).view(np.int64)]

    return map_texts(df, [key], text, run, "fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Sets:
    """Component labels of leaves, all up to date: label = smallest leaf of the component."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while not np.array_equal(up := label[label], label):  # point at the roots
                label[:] = up


def _levels(leaves: np.ndarray, masks: list[tuple[int, np.uint64]]) -> list[np.ndarray]:
    """For each level where its nodes start among the sorted leaves: a node is a run with equal bits under the masks so far."""
    starts, new = [], np.zeros(len(leaves), bool)
    new[:1] = True
    for word, mask in masks:
        part = leaves[:, word] & mask
        new[1:] |= part[1:] != part[:-1]
        starts.append(np.flatnonzero(new))
    return starts


#: Node pairs that are expanded at a time.
FRONTIER = 1 << 18


def link_leaves(fp: np.ndarray, band: tuple[int, int], bits: int, tail: int = 0) -> np.ndarray:
    """For distinct fingerprints (a row of words each): index of a member of each one's component, over links in which `band` agrees.

    band: a word's index and a mask of its bits. A link differs in `bits` bits at
    most; the last `tail` words tell fingerprints apart but differ at no cost.
    """
    n_words = fp.shape[1] - tail
    home, inside = band
    rest = [i for i in range(63, -1, -1) if not inside >> i & 1]
    masks = [(home, np.uint64(inside))] + [(home, np.uint64(sum(1 << i for i in rest[k : k + 8]))) for k in range(0, len(rest), 8)]
    for w in range(fp.shape[1]):
        if w != home:
            masks += [(w, np.uint64(0xFF << k)) for k in range(56, -1, -8)]
    # Gray rank within each mask, highest level first: neighbours in the order differ in few bits, nodes are runs.
    order = np.lexsort([gray_rank(fp[:, w] & m) for w, m in reversed(masks)])
    leaves, sets = fp[order], _Sets(len(fp))
    starts = _levels(leaves, masks)
    n_levels = len(masks)
    first = [np.searchsorted(starts[i + 1], starts[i]) for i in range(n_levels - 1)]
    last = [np.searchsorted(starts[i + 1], np.append(starts[i][1:], len(leaves))) for i in range(n_levels - 1)]
    leaf_end = [np.append(s[1:], len(leaves)) for s in starts]

    roots = np.arange(len(starts[0]))
    big = roots[leaf_end[0] - starts[0] > 1]
    stack = [(0, big[k : k + FRONTIER], big[k : k + FRONTIER], np.zeros(len(big[k : k + FRONTIER]), np.int64)) for k in range(0, len(big), FRONTIER)]
    single = [e - f == 1 for f, e in zip(starts, leaf_end, strict=True)]
    while stack:
        level, a, b, seen = stack.pop()
        one = _uniform(sets.label, starts[level], leaf_end[level])
        live = ~(one[a] & one[b] & (sets.label[starts[level][a]] == sets.label[starts[level][b]]))
        a, b, seen = a[live], b[live], seen[live]
        if not len(a):
            continue
        fa, na, fb, nb = first[level][a], last[level][a] - first[level][a], first[level][b], last[level][b] - first[level][b]
        size = na * nb
        upto = np.cumsum(size)
        cut = int(np.searchsorted(upto, FRONTIER)) + 1  # whole pairs; a pair of wide nodes has 256 x 256 children at most
        if cut < len(a):
            stack.append((level, a[cut:], b[cut:], seen[cut:]))
            a, b, seen, fa, na, fb, nb, size, upto = (v[:cut] for v in (a, b, seen, fa, na, fb, nb, size, upto))
        pair = np.repeat(np.arange(len(a)), size)
        k = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
        ca, cb = fa[pair] + k // nb[pair], fb[pair] + k % nb[pair]
        keep = (a[pair] != b[pair]) | (ca <= cb)
        pair, ca, cb = pair[keep], ca[keep], cb[keep]
        w, m = masks[level + 1]
        diff = seen[pair] + (w < n_words) * np.bitwise_count((leaves[starts[level + 1][ca], w] ^ leaves[starts[level + 1][cb], w]) & m)
        alone = single[level + 1]
        keep = (diff <= bits) & ((ca != cb) | ~alone[ca])
        ca, cb, diff = ca[keep], cb[keep], diff[keep]
        lone = alone[ca] & alone[cb]  # two fingerprints are left: compared at once, unless known as linked
        x, y = starts[level + 1][ca[lone]], starts[level + 1][cb[lone]]
        apart = sets.label[x] != sets.label[y]
        x, y = x[apart], y[apart]
        far = np.zeros(len(x), np.int64)
        for j in range(n_words):
            far += np.bitwise_count(leaves[x, j] ^ leaves[y, j])
        hit = far <= bits
        sets.link(x[hit], y[hit])
        ca, cb, diff = ca[~lone], cb[~lone], diff[~lone]
        near = np.argsort(-diff, kind="stable")  # the stack takes the nearest last in, so first out
        for at in range(0, len(ca), FRONTIER):
            own = near[at : at + FRONTIER]
            stack.append((level + 1, ca[own], cb[own], diff[own]))
    out = np.empty(len(fp), np.int64)
    out[order] = order[sets.label]
    return out


def _uniform(label: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether all leaves of each node are in one component."""
    change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    return change[ends - 1] == change[starts]


def bands(bits: int = 2, within: int = (1 << 64) - 1) -> list[int]:
    """bits+1 masks that part the bits of `within` into runs of nearly equal length."""
    own = [i for i in range(64) if within >> i & 1]
    edges = [round(len(own) * i / (bits + 1)) for i in range(bits + 2)]
    return [sum(1 << i for i in own[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _star(root: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
    """Links of each member of a component to its smallest rep."""
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, root, rep)
    dst = least[root]
    own = dst != rep
    return pd.DataFrame({"src": rep[own], "dst": dst[own]})


#: Distinct fingerprints that one bucket should hold; those that share a band's value from which it is parted further.
BUCKET_ROWS, HOT_ROWS = 20_000, 50_000


def _hot(dealt: DataFrame) -> DataFrame | None:
    """(band, value) that over HOT_ROWS fingerprints share, if any."""
    found = checkpointed(dealt.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("band", "value"))
    return None if found.isEmpty() else found


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(src, dst): a spanning star, in each bucket, of the links between distinct fingerprints.

    fps: fp long (distinct), rep long. src and dst are reps; dst is the smaller
    end. The count of buckets follows the count of fingerprints.
    """
    buckets = max(64, fps.count() // BUCKET_ROWS)
    masks = bands(bits)
    finer = {i: bands(bits, ((1 << 64) - 1) & ~m) for i, m in enumerate(masks)}
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fp, rep = part["fp"].to_numpy().view(np.uint64), part["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        fp, rep = fp[order], rep[order]
        band, sub = int(key[0]), int(key[1])
        mask = masks[band] | (finer[band][sub] if sub >= 0 else 0)
        return _star(link_leaves(fp[:, None], (0, mask), bits), rep)

    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", "rep", F.explode(keys).alias("t")).select("t.band", F.lit(-1).alias("sub"), "t.value", "fp", "rep")
    if (hot := _hot(dealt)) is not None:
        # of a value that very many share the other bits are banded again: a pair within the limit agrees in one of those bands too
        subs = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(j).alias("sub"), F.col("fp").bitwiseAND(signed(masks[i] | m)).alias("value")) for i in finer for j, m in enumerate(finer[i])])
        inner = dealt.join(hot, ["band", "value"], "left_semi").select("band", "fp", "rep", F.explode(subs).alias("t")).where("t.b = band")
        dealt = dealt.join(hot, ["band", "value"], "left_anti").select("band", "sub", "value", "fp", "rep").unionByName(inner.select("band", "t.sub", "t.value", "fp", "rep"))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("band", "sub", "value"), F.lit(buckets))).groupBy("band", "sub", "bucket").applyInPandas(run, "src long, dst long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: the smallest key reachable over links of at most `bits` bits.

    Null and empty texts share fingerprint zero and link like any other. Rows
    with a null key take no part in components and have a null component_id.
    Repeated rows give a row each, an empty table none; other columns, whatever
    their names, are not read. Very long texts are hashed in steps. Work grows
    with distinct fingerprints, not with pairs: equal fingerprints are one node,
    a bucket's links are a star.
    """
    prints = checkpointed(fingerprints(df, key, text, width))
    nodes = checkpointed(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).cast("long").alias("rep")))
    edges = checkpointed(links(nodes, bits).distinct())
    labels = min_labels(edges)
    named = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp", "left").select(key, hexed, F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


#: Share of near pairs at the similarity asked for that the bands of the wide index must find, and by how many deviations a pair's bits may exceed the mean.
RECALL, SLACK = 0.97, 3.0


def wide_index(n: int, similarity: float) -> tuple[int, int, int, int]:
    """Words, bits of a band, bands of a word, and most differing bits for n fingerprints and a resemblance of shingle sets.

    At resemblance J a bit differs with chance arccos(2J / (1 + J)) / pi. Bands
    are wide enough for buckets of about 64 at any n; words are added until a
    pair at J agrees in one band with the chance RECALL. The limit in bits only
    chooses what is compared: it lets 99.8 % of the pairs at J pass.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(8, math.ceil(math.log2(max(2, n))) - 6)
    each = 64 // width
    words = max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** width) / each))
    return words, width, each, math.floor(64 * words * differ + SLACK * math.sqrt(64 * words * differ * (1 - differ)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, width))


#: Bytes of shingle sets that a task compares with each other, about.
BLOCK_BYTES = 8_000_000


def link_sets(fp: np.ndarray, sets: list[np.ndarray], bits: int, similarity: float, family: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join texts of resemblance `similarity` or more into the components that all such pairs make.

    fp: a row of words for each text; only pairs within `bits` bits are
    compared, and none of one family or of texts that are joined already.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    start = np.cumsum(size) - size
    _, flat = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    label = np.arange(n) if family is None else np.unique(family, return_inverse=True)[1]
    own = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    left, right = [], []
    for i in range(n - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        if not len(j):
            continue
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(1, dtype=np.int64) <= bits]
        mine = flat[start[i] : start[i] + size[i]]
        own[mine] = True
        upto, a = np.cumsum(size[j]), 0
        while a < len(j):  # so many at a time as BLOCK_BYTES hold
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK_BYTES // 8)))
            k, w = j[a:b], size[j[a:b]]
            heads = np.cumsum(w) - w
            at = np.repeat(start[k] - heads, w) + np.arange(int(w.sum()))
            seen = np.concatenate(([0], np.cumsum(own[flat[at]])))
            common = seen[heads + w] - seen[heads]
            all_of = size[i] + w - common
            for t in k[(common >= similarity * all_of) | (all_of == 0)].tolist():
                if label[t] != label[i]:
                    left.append(i)
                    right.append(t)
                    label[label == label[t]] = label[i]
            a = b
        own[mine] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def candidate_groups(nodes: DataFrame, words: int, band_bits: int, each: int, bits: int) -> DataFrame:
    """(node, label): reps whose fingerprints, of `words` words and a digest, differ in `bits` bits at most and agree in a band, joined to groups.

    A band's value that over HOT_ROWS fingerprints share makes one group as it
    is; groups only choose what is compared.
    """
    buckets = max(8, nodes.count() // BUCKET_ROWS)
    matrix = lambda fps: np.frombuffer(b"".join(fps), np.uint64).reshape(-1, words + 1)
    value_of = lambda fp, band: (fp[:, band // each] >> np.uint64(band % each * band_bits)) & np.uint64((1 << band_bits) - 1)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = matrix(part["fp"])
            for band in range(words * each):
                yield pd.DataFrame({"band": band, "value": value_of(fp, band).astype(np.int64), "fp": part["fp"], "rep": part["rep"]})

    def star(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        word, place = divmod(int(key[0]), each)  # a Python int: a shifted 32-bit one overflows
        part = part.sort_values("rep")
        return _star(link_leaves(matrix(part["fp"]), (word, ((1 << band_bits) - 1) << (place * band_bits)), bits, 1), part["rep"].to_numpy())

    dealt = nodes.select("fp", "rep").mapInPandas(deal, "band int, value long, fp binary, rep long")
    crowd = None
    if (hot := _hot(dealt)) is not None:
        inner = dealt.join(hot, ["band", "value"], "left_semi").select("band", "value", "rep")
        least = inner.groupBy("band", "value").agg(F.min("rep").alias("dst"))
        crowd = inner.join(least, ["band", "value"]).select(F.col("rep").alias("src"), "dst")
        dealt = dealt.join(hot, ["band", "value"], "left_anti")
    bucket = F.pmod(F.xxhash64("band", "value"), F.lit(buckets))
    found = dealt.withColumn("bucket", bucket).groupBy("band", "bucket").applyInPandas(star, "src long, dst long")
    return min_labels(found if crowd is None else found.unionByName(crowd))


def _compared(members: DataFrame, words: int, bits: int, similarity: float) -> DataFrame:
    """(src, dst) links among members (task, label, rep, family, fp, shingles) of one task and label and different families."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for _, own in part.groupby("label"):
            own = own.sort_values("rep")
            fp = np.frombuffer(b"".join(own["fp"]), np.uint64).reshape(-1, words + 1)[:, :words]
            rep = own["rep"].to_numpy()
            a, b = link_sets(fp, [np.frombuffer(s, np.uint64) for s in own["shingles"]], bits, similarity, own["family"].to_numpy())
            src.append(rep[b])
            dst.append(rep[a])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return members.groupBy("task").applyInPandas(run, "src long, dst long")


def verified(members: DataFrame, words: int, bits: int, similarity: float) -> DataFrame:
    """(node, label): components over links of exact resemblance among members (label, rep, fp, shingles) of one candidate group.

    Groups of up to BLOCK_BYTES are compared whole, many of them in a task.
    Larger ones are dealt into blocks: first each block is compared in itself,
    together with the group's first member; then, where that leaves several
    families, each two blocks meet, but for two blocks of the largest family.
    """
    size = F.length("shingles") + F.lit(64)
    groups = checkpointed(members.groupBy("label").agg(F.sum(size).alias("bytes"), F.min("rep").alias("first")).withColumn("f", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")))
    total, most = groups.agg(F.sum("bytes"), F.max("f")).head()
    tasks = max(8, int((total or 0) // BLOCK_BYTES))
    members = members.join(groups.select("label", "first", "f"), "label").withColumn("family", F.col("rep"))
    own = F.xxhash64("rep", "fp")
    one = F.struct(F.pmod(F.xxhash64("label"), F.lit(tasks)).cast("long").alias("a"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    small = members.where("f = 1").withColumn("task", one)
    if (most or 1) == 1:
        return min_labels(_compared(small, words, bits, similarity))
    large = checkpointed(members.where("f > 1"))
    every = F.when(F.col("rep") == F.col("first"), F.sequence(F.lit(0), F.col("f") - 1)).otherwise(F.array(F.pmod(own, F.col("f")).cast("int")))
    in_block = large.withColumn("i", F.explode(every)).withColumn("task", F.struct(F.col("label").alias("a"), "i", F.lit(-1).alias("j"))).drop("i")
    links = checkpointed(_compared(small.unionByName(in_block, allowMissingColumns=True), words, bits, similarity))
    families = min_labels(links)
    left = large.drop("family").join(families.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    sizes = left.groupBy("label", "family").agg(F.sum(size).alias("b"))
    sizes = sizes.groupBy("label").agg(F.sum("b").alias("b"), F.max(F.struct("b", "family")).alias("main"))
    blocks = lambda b: F.greatest(F.lit(1), F.ceil(b * 2 / F.lit(BLOCK_BYTES))).cast("int")
    sizes = sizes.where(F.col("b") > F.col("main.b")).select("label", F.col("main.family").alias("main"), blocks(F.col("main.b")).alias("m"), blocks(F.col("b") - F.col("main.b")).alias("r"))
    is_main = F.col("family") == F.col("main")
    met = left.join(sizes, "label").withColumn("i", F.when(is_main, F.pmod(own, F.col("m"))).otherwise(F.col("m") + F.pmod(own, F.col("r"))).cast("int"))
    met = met.withColumn("k", F.explode(F.sequence(F.when(is_main, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("r") - 1)))
    met = met.withColumn("task", F.struct(F.col("label").alias("a"), F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"))).select("task", "label", "rep", "family", "fp", "shingles")
    return min_labels(links.unionByName(checkpointed(_compared(met, words, bits, similarity))))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """key, component_id: the smallest key reachable over links of resemblance `similarity` or more.

    Resemblance is that of two texts' sets of `width`-word shingles, computed
    exactly. Fingerprints of the sets, of 256 bits or more, indexed like the
    short ones with a band as the top node, only choose groups whose members are
    compared. Texts without a word, null ones included, are alike. Null keys are
    not linked and not returned. Texts that share a key are one document, and
    repeated rows give one row. Empty tables give none. A very long text is one
    set of 8 bytes a shingle. Other columns of df, whatever their names, are not
    read.
    """
    keyed = df.where(F.col(key).isNotNull())
    words, band_bits, each, bits = wide_index(keyed.count(), similarity)

    def run(texts: list) -> list[list]:
        sets = [shingle_set(t, width) for t in texts]
        return [[_simhash(s, words).tobytes() + xxhash.xxh64_digest(s.tobytes(), SEED) for s in sets]]  # the digest tells sets of one fingerprint apart

    def both(texts: list) -> list[list]:
        return [*run(texts), [shingle_set(t, width).tobytes() for t in texts]]

    prints = checkpointed(map_texts(keyed, [key], text, run, "fp binary"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(key).cast("long").alias("rep")))
    groups = candidate_groups(nodes, words, band_bits, each, bits)
    grouped = nodes.join(groups, nodes["rep"] == groups["node"]).select("label", "rep", "fp")
    chosen = keyed.join(grouped.select(F.col("rep").alias("__rep")).distinct(), F.col(key).cast("long") == F.col("__rep"), "left_semi")
    sets = map_texts(chosen, [key], text, both, "fp binary, shingles binary").select(F.col(key).cast("long").alias("rep"), "fp", "shingles")
    members = materialised(grouped.join(sets.dropDuplicates(["rep", "fp"]), ["rep", "fp"]).select("label", "rep", "fp", "shingles"))
    labels = verified(members, words, bits, similarity)
    several = prints.groupBy(key).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select(key)
    tied = checkpointed(prints.join(several, key, "left_semi").join(nodes, "fp").select(F.col(key).cast("long").alias("src"), F.col("rep").alias("dst")).where("src <> dst"))
    if not tied.isEmpty():
        labels = min_labels(tied.union(labels.select("node", "label")))
    named = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return prints.join(named, "fp").groupBy(key).agg(F.min("component_id").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of df without near copies: of each component the row with the smallest key; rows with a null key stay.

    Of rows that share the smallest key one stays.
    """
    found = near_copies(df, key, text, similarity, width).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept"))
    kept = df.join(found, df[key] == found["__kept"], "left_semi")
    by = Window.partitionBy(key).orderBy(*[F.hash(c) for c in df.columns], text)
    kept = kept.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
    return kept.unionByName(df.where(F.col(key).isNull()))
