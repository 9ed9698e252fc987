"""Source divergence, centroid clustering and exact dedup against plain versions, and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import clustering, divergence, exact, quotient

DOCS = "doc_id long, text string, lang string, source string"


def extra(df):
    """Columns whose names clash with those used inside."""
    for c in ("term", "n", "low", "fp", "norm", "key", "vec", "group_size", "item"):
        df = df.withColumn(c, F.lit("x"))
    return df


def plain_divergence(rows, least, top):
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    found = [(la or "", so or "", re.findall(divergence.LETTER + "+", (t or "").translate(low))) for _, t, la, so in rows]
    have, count, lang_count = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for la, so, words in found:
        have[la].update(set(words))
        count[la, so].update(words)
        lang_count[la].update(words)
    out = []
    for la in {x[0] for x in found}:
        kept = [t for t, n in have[la].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = p(lang_count[la])
        own = {so: p(count[la, so]) for so in {x[1] for x in found if x[0] == la}}
        for so, f in own.items():
            pairs = sorted(((-sum(abs(f[t] - g[t]) for t in kept), other.encode(), other) for other, g in own.items() if other != so))
            out += [(la, so, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            more = sorted((q[t] - f[t], t.encode(), t) for t in kept if count[la, so][t] > 0 and f[t] > q[t])
            out += [(la, so, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:top])]
    return sorted(out)


@pytest.mark.parametrize("piece", [divergence.PIECE, 40])
def test_divergence_by_brute_force(spark, piece):
    rng = random.Random(3)
    words = ["alpha", "BETA", "beta", "ünï", "Ünï", "gamma7delta", "x", "日本", "\U0001d400", "don't", "éa"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 11)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"])) for i in range(120)]
    rows += [(1, None, "en", "s9"), (None, "", None, None), (2, "alone", "only", "one"), (3, "", "bare", "a"), (4, None, "bare", "b"), (5, "same same", "en", "s1"), (5, "same same", "en", "s1")]
    df = extra(spark.createDataFrame(rows, DOCS))
    got = sorted(map(tuple, divergence.divergence(df, least_docs=4, top_terms=3, piece=piece).collect()))
    assert got == plain_divergence(rows, 4, 3)
    assert ("bare", "a", "pair", "b", 0, 1) in got


def test_divergence_of_a_long_text_counts_it_as_one_document(spark):
    rows = [(1, "ab " * 5000 + "CD" * 4000, "en", "s"), (2, "ab", "en", "t")]
    got = {r["term"]: (r["n"], r["docs"]) for r in divergence.counted(spark.createDataFrame(rows, DOCS), piece=100).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert got == {"ab": (5001, 2), "cd" * 4000: (1, 1)}


def test_frequencies_beyond_64_bits(spark):
    row = spark.sql("SELECT 5000000000000 AS n, 80000000000000 AS total, 1000 AS kept").select(divergence.per_whole("n", "total", "kept").alias("p")).head()
    assert row["p"] == 1 + 10**9 * (5 * 10**12 + 5) // (80 * 10**12 + 5000)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def plain_clusters(vectors, k=16, rounds=3):
    x = {i: [clustering.whole(float(v), 64) for v in vec] for i, (_, vec) in enumerate(vectors)}
    order = sorted(x, key=lambda i: (hashlib.sha256(f"1:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest(), list(vectors[i][1])))
    cents = [x[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in x.values():
            groups[near(v)[1]].append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(cents)]
    return cents, [near(x[i]) for i in range(len(vectors))]


def check_clusters(spark, vectors, kind="double", dims=4):
    df = extra(spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").repartition(3))
    got = clustering.cluster(df, dims=dims).collect()
    cents, near = plain_clusters([(i, v) for i, v in vectors if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)])
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    fits = lambda v: v if v < 1 << 63 else None
    keys = [i for i, v in vectors if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    want = [(i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, (d, c) in zip(keys, near, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=4) + i % 3).tolist()) for i in range(150)]
    vectors += [(7, [0.0] * 4), (7, [0.0] * 4), (None, [1.0, 2.0, 3.0, 4.0]), (8, None), (9, []), (10, [1.0] * 3), (11, [1.0, None, 1.0, 1.0]), (12, [math.nan] * 4), (13, [math.inf, 0.0, 0.0, 0.0]), (14, [-0.001] * 4)]
    check_clusters(spark, vectors)


def test_clusters_beyond_doubles_and_64_bits(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 12)).tolist()) for i in range(60)]
    check_clusters(spark, vectors + [(100 + i, [1e300 * i, -1e307, 5e-324, 2.0**53 + 2]) for i in range(4)])


def test_fewer_vectors_than_centroids(spark):
    check_clusters(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])])
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_products_and_differences_agree():
    rng = np.random.default_rng(7)
    x, cents = rng.normal(size=(300, 64)) * 3, [[int(v) for v in row] for row in rng.integers(-400, 400, (16, 64))]
    found = clustering.assign(x, cents)
    gap = np.floor(x * 64).astype(np.int64)[:, None, :] - np.array(cents)
    d = (gap * gap).sum(2)
    assert found.exact.all() and (found.cluster == d.argmin(1)).all() and (found.distance == d.min(1)).all()


@pytest.mark.parametrize("width", [64, 58, 20])
def test_filter_gives_back_what_it_got(width):
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 1000):
        h = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64) & np.uint64((1 << width) - 1))
        counts = np.where(rng.random(len(h)) < 0.3, rng.integers(2, 1 << 40, len(h)), 1).astype(np.int64)
        back = quotient.read(quotient.build(h, counts, width))
        assert (back[0] == h).all() and (back[1] == counts).all()


def test_filters_merge_losslessly():
    rng = np.random.default_rng(9)
    parts = [rng.integers(0, 500, 300).astype(np.uint64) << np.uint64(40) for _ in range(5)]
    filters = [quotient.build(*quotient.added(np.array(p), np.ones(len(p), np.int64)), 58) for p in parts]
    h, n = quotient.merge(filters)
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, members in groups.items():
        first = min(members)
        out += [(rows[m[3]][0], rows[first[3]][0], len(members), m is first or m[3] == first[3], hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_exact_dedup_by_brute_force(spark):
    rng = random.Random(10)
    base = ["a b c", "abc", "a b", "", " \n", "z" * 3000, "\U0001f600 x", "é" * 10]
    rows = [(i, "".join(c + rng.choice(["", "", " ", "\t"]) for c in rng.choice(base))) for i in range(300)] + [(1000 + i, f"one {i}") for i in range(100)]
    rows += [(5, "twice"), (5, "twice"), (5, "twi ce"), (None, "twice"), (None, "no id"), (None, "no id"), (9, None), (8, None), (3, "word " * 50000), (2, "word  " * 50000)]
    got = exact.dedup(extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)


def test_texts_with_one_fingerprint_are_told_apart_by_their_bytes(spark, monkeypatch):
    rows = [(i, f"text {i % 40}") for i in range(120)]
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)


def test_a_full_bitmap_only_sends_more_to_verification(spark, monkeypatch):
    monkeypatch.setattr(exact, "MOST_BITS", 12)
    rows = [(i, f"text {i % 3000}") for i in range(9000)]
    got = exact.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
