"""SimHash, suffix arrays, sketches, LM scores, mixing and nearest neighbours against brute force, and odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import ann, components, mixing, ngram_lm, queries, simhash, sketch, suffixes
from quillon.session import table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, 1), (2, "", "en", "s", 2), (2, "", "en", "s", 3), (None, "a b c d e f", None, "s", 4), (5, " \n\t", "xx", None, 5), (6, "word " * 20000, "en", "s", 6), (7, "one two", "en", "s", 7), (8, "one two", "en", "t", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label int").withColumn("fp", F.lit(1)).withColumn("block", F.lit("x")).withColumn("tokens", F.lit(0))


def plain_fingerprint(text, width=3):
    words = (text or "").lower().split() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_by_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = " ".join(rng.choice(["Ab", "c", "DE", "f1"]) for _ in range(n))
        assert int(simhash.fingerprint(text)[0]) == plain_fingerprint(text)


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(int(x), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def closure(near):
    lab = np.arange(len(near))
    while True:
        new = np.array([lab[r].min() for r in near])
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize(("words", "band", "bits", "flips"), [(1, (0, (1 << 21) - 1), 2, 4), (4, (1, (1 << 10) - 1), 40, 45)])
def test_index_by_brute_force(words, band, bits, flips):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (300, words), dtype=np.int64).view(np.uint64)
    parts = [base]
    for _ in range(3):
        c = base.copy()
        for r in range(len(c)):
            for i in rng.integers(0, 64 * words, rng.integers(0, flips)):
                c[r, i // 64] ^= np.uint64(1 << int(i % 64))
        parts.append(c)
    x = np.unique(np.concatenate(parts), axis=0)
    rng.shuffle(x)
    far = sum(np.bitwise_count(x[:, None, j] ^ x[None, :, j]).astype(int) for j in range(words))
    near = (far <= bits) & (((x[:, None, band[0]] ^ x[None, :, band[0]]) & np.uint64(band[1])) == 0)
    assert partition(simhash.link_leaves(x, band, bits)) == partition(closure(near))


def test_gray_rank_orders_neighbours():
    ranks = simhash.gray_rank(np.arange(256, dtype=np.uint64))
    order = np.argsort(ranks)
    assert all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("hot", [None, 3])
def test_near_duplicates_by_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)  # shared values are parted further
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(400)) for _ in range(25)]
    texts += [t + " tail" for t in texts[:15]] + texts[:5] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    lab = closure(np.array([[bin(a ^ b).count("1") <= 2 for b in fp] for a in fp]))
    assert [got[i]["component_id"] for i in range(len(texts))] == lab.tolist()
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fp
    assert len(set(lab.tolist())) < 30


def test_simhash_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (2, 1), (5, 1), (7, 7), (8, 7), (None, None)} <= by
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert sorted(x or 0 for x in kept) == [0, 1, 6, 7]
    assert simhash.near_duplicates(odd.where("false")).count() == 0 and simhash.keep_one(odd.where("false")).count() == 0


@pytest.mark.parametrize("hot", [None, 1])
def test_near_copies_find_edits_and_spare_others(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        c = list(b)
        for _ in range(3):
            c[rng.randrange(len(c))] = word()
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(lab[40 + i] == i for i in range(20)) and all(lab[i] == i for i in range(40))


def plain_jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_link_by_exact_resemblance(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(404)] for _ in range(40)]  # 400 shingles
    texts = [" ".join(b) for b in base]
    for b, edge in ((b, 60 if i < 20 else 40) for i, b in enumerate(base)):  # a changed end of 60 words: 340 of 460 are common; of 40: 360 of 440
        texts.append(" ".join(b[:-edge] + [word() for _ in range(edge)]))
    repeated = "one two three four five " * 2000  # its repeats outweigh all else in a count of shingles
    texts += [repeated + " ".join(word() for _ in range(100)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    like = [plain_jaccard(texts[i], texts[40 + i]) for i in range(40)]
    assert all(0.7 < j < 0.8 for j in like[:20]) and all(j > 0.8 for j in like[20:])
    assert all(lab[40 + i] == 40 + i for i in range(20))  # 0.74 is no near copy
    assert sum(lab[40 + i] == i for i in range(20, 40)) >= 18 and lab[80] == 80 and lab[81] == 81


def test_link_sets_by_brute_force():
    rng = np.random.default_rng(4)
    base = [rng.choice(60, 20, replace=False) for _ in range(20)]
    sets = [np.unique(np.concatenate((rng.choice(base[i % 20], 16, replace=False), rng.integers(0, 60, 3)))).astype(np.uint64) for i in range(147)] + [np.zeros(0, np.uint64)] * 3
    family = rng.integers(0, 60, 150)
    fp = np.zeros((150, 2), np.uint64)
    fp[:75, 0] = np.uint64(7)
    near = np.array([[fp[i, 0] == fp[j, 0] and (len(np.intersect1d(x, y)) >= 0.6 * len(np.union1d(x, y))) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    want = closure(near | (family[:, None] == family[None, :]))
    a, b = simhash.link_sets(fp, sets, 2, 0.6, family)
    made = family[:, None] == family[None, :]
    made[a, b] = made[b, a] = True
    assert (closure(made) == want).all() and near[a, b].all() and len(a) > 5


@pytest.mark.parametrize(("hot", "block"), [(50_000, 8_000_000), (100, 100_000)])
def test_one_large_group_of_near_copies(spark, monkeypatch, hot, block):
    """2,000 edits of one absent text, of which any two are about as like as the limit, and 400 exact copies."""
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(2_000):
        t = list(base)
        for k in range(1 if i % 3 else 2):
            t[rng.randrange(60)] = f"x{i}y{k}"
        texts.append(" ".join(t))
    texts += [texts[5]] * 400
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = [simhash.shingle_set(t, 5) for t in texts[:2_000]]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sizes = np.array([len(h) for h in hashes])
    m = np.zeros((2_000, at.max() + 1), np.float32)
    m[np.repeat(np.arange(2_000), sizes), at] = 1
    common = m @ m.T
    alike = common >= 0.8 * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    want = closure(alike)
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(lab[i] == lab[5] for i in range(2_000, 2_400))
    got = np.array([lab[i] for i in range(2_000)])
    assert (got >= want).all() and (got == want).mean() > 0.97 and 100 < len(set(want.tolist())) < 1_900
    assert all(want[g] == want[i] for i, g in enumerate(got.tolist()))


def test_near_copies_recall(spark):
    """Of all pairs at 0.8 or more, queries being the ids divisible by 50, nine in ten at least are in one component."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").toPandas()
    rng = random.Random(3)
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for k in [k for k in texts if k % 50 == 0 and texts[k] and 40 < len(texts[k].split()) < 400]:
        words = texts[k].split(" ")
        for _ in range(max(1, len(words) // 50)):  # at the limit or a little over it
            words[rng.randrange(len(words))] = "changed"
        texts[10_000_000 + k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    sets = {k: simhash.shingle_set(t, 5) for k, t in texts.items()}
    keys = np.array(list(sets))
    sizes = np.array([len(sets[k]) for k in keys])
    owner = np.repeat(np.arange(len(keys)), sizes)
    _, flat = np.unique(np.concatenate([sets[k] for k in keys]), return_inverse=True)
    found = pairs = 0
    for i in np.flatnonzero((keys % 50 == 0) & (sizes > 1)):
        mark = np.zeros(flat.max() + 1, bool)
        mark[flat[owner == i]] = True
        common = np.bincount(owner, weights=mark[flat], minlength=len(keys))
        like = np.flatnonzero(common >= 0.8 * (sizes + sizes[i] - common))
        like = like[like != i]
        pairs += len(like)
        found += sum(lab[keys[j]] == lab[keys[i]] for j in like)
    assert pairs > 100 and found >= 0.9 * pairs


def test_hot_bands_lose_no_near_copy(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(404)] for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-40] + [word() for _ in range(40)]) for b in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, width, each, bits = index = simhash.wide_index(100_000, 0.8)
    monkeypatch.setattr(simhash, "wide_index", lambda n, similarity: index)
    prints = [simhash._simhash(simhash.shingle_set(t, 5), words) for t in texts]
    values = [[int(fp[w]) >> k * width & (1 << width) - 1 for w in range(words) for k in range(each)] for fp in prints]
    common = [sum(a == b for a, b in zip(values[i], values[60 + i], strict=True)) for i in range(60)]
    near = [sum(int(x).bit_count() for x in prints[i] ^ prints[60 + i]) <= bits and common[i] > 0 for i in range(60)]
    assert any(n and c == 1 for n, c in zip(near, common, strict=True)) and sum(near) >= 54  # some pairs share one band only
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)  # all shared values are hot
    lab = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert all(lab[60 + i] == i for i in range(60) if near[i])


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components.min_labels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and 200 not in got
    assert components.min_labels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_stars_never_grow_and_end_with_a_link_a_node(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(15), i) for i in range(15, 4_000) for _ in range(12)} | {(5_000 + i, 5_001 + i) for i in range(64)}
    links = spark.createDataFrame([(b, a) for a, b in edges], "hi long, lo long").where("hi > lo").union(spark.createDataFrame([(5_001 + i, 5_000 + i) for i in range(64)], "hi long, lo long")).distinct()
    sizes = [links.count()]
    for _ in range(3):
        links = components.small_star(components.large_star(links))
        sizes.append(links.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] <= 2 * 4_065
    got = {r["node"]: r["label"] for r in components.min_labels(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
    assert all(got[i] == got[15] for i in range(15, 4_000)) and all(got[5_000 + i] == 5_000 for i in range(65))


@pytest.mark.parametrize("hot", [None, 2])
def test_repeats_by_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffixes, "HOT", hot)  # every shared anchor is dealt string by string
    rng = random.Random(7)
    passages = ["".join(rng.choice("ab cdé\n") for _ in range(n)) for n in (49, 50, 51, 70, 200, 400)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("xyz w") for _ in range(rng.randint(0, 80))) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, "ab" * 300), (501, "ab" * 200), (502, "a" * 49), (503, None)]
    got = {r["doc_id"]: r for r in suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = suffixes.brute_force(rows)
    for k, t in rows:
        raw = (t or "").encode()
        assert [(s["start"], s["end"]) for s in got[k]["spans"]] == want[k], k
        kept, at = b"", 0
        for a, b in want[k]:
            kept, at = kept + raw[at:a], b
        assert bytes(got[k]["kept"]) == kept + raw[at:] and got[k]["n_bytes"] == len(raw)


def test_maximal_repeats_list_all_occurrences():
    texts = [b"XX" + b"common passage of text" + b"1", b"YY" + b"common passage of text" + b"2", b"Z" + b"common passage of text" + b"3"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    seg, off, size, low, _ = suffixes.maximal_repeats(data, start, end, np.array([5, 3, 9]), np.array([5, 3, 9]), 10)
    assert sorted(zip(seg.tolist(), off.tolist(), size.tolist(), low.tolist(), strict=True)) == [(0, 2, 22, 3), (1, 2, 22, 3), (2, 1, 22, 3)]


def test_interval_tree_by_stack():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lcp = rng.integers(0, 6, rng.integers(0, 30))
        want, stack = set(), []
        for i, v in enumerate([*lcp.tolist(), 0]):
            left = i
            while stack and stack[-1][0] > v:
                d, left = stack.pop()
                want.add((left, i, d))
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, left))
        got = set(zip(*[x.tolist() for x in suffixes.intervals(lcp, 2)], strict=True))
        assert got == {w for w in want if w[2] >= 2}


def test_repeat_rows(spark, odd):
    rows = suffixes.repeated_spans(odd).collect()
    assert len(rows) == odd.count() and {r["n_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert suffixes.repeated_spans(odd.where("false")).count() == 0
    same = spark.createDataFrame([(1, "q" * 60), (1, "q" * 60), (None, "q" * 60), (2, "q" * 60)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in suffixes.repeated_spans(same).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(words[:2000]), " ".join(words[500:2500])), ("a b", "a b"), ("", ""), ("", "x"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = sketch.sketches(df, "a").withColumnRenamed("sketch", "sa"), None
    b = sketch.sketches(a, "b")
    got = b.select(sketch.resemblance(F.col("sa"), F.col("sketch")).alias("r"), sketch.containment(F.col("sa"), F.col("sketch")).alias("c"), sketch.distinct_shingles(F.col("sa")).alias("n")).collect()
    assert got[0]["r"] == pytest.approx(0.6, abs=0.2) and got[0]["c"] == pytest.approx(0.75, abs=0.25) and got[0]["n"] == pytest.approx(1996, rel=0.4)
    assert [g["r"] for g in got[1:]] == [1.0, 1.0, 0.0, 1.0] and got[1]["n"] == 1 and got[2]["n"] == 0


def test_fingerprints_by_brute_force(spark):
    """op5 on all documents: edited texts exactly; likeness, containment and counts exactly up to K shingles, near the truth beyond."""
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, D, "documents").collect()}
    order = sorted(docs, reverse=True)

    def shingles(t):
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off = {"near_edited": [], "near_next": [], "contained": []}
    for r in queries.op5_fingerprints(spark, D).collect():
        text, after = docs[r["doc_id"]], docs[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        for name, got, want, both in (("near_edited", r["near_edited"], like(a, b), a | b), ("near_next", r["near_next"], like(a, c), a | c)):
            off[name].append(abs(got - want))
            assert abs(got - want) < (1e-9 if len(both) < sketch.K else 0.3)
        off["contained"].append(abs(r["contained"] - (len(a & b) / len(a) if a else 1.0)))
        assert r["n_shingles"] == len(a) if len(a) < sketch.K else abs(r["n_shingles"] / len(a) - 1) < 0.6
    assert all(sum(v) / len(v) < 0.06 for v in off.values())


def test_sketches_merge_like_the_whole(spark):
    docs = spark.createDataFrame([("g", f"p{i} q r s t u v{i}") for i in range(60)], "g string, text string")
    parts = sketch.merged(sketch.sketches(docs), ["g"]).head()["sketch"]
    halves = [sketch.merged(sketch.sketches(docs.where(c)), ["g"]).select("g", "sketch") for c in ("text < 'p3'", "text >= 'p3'")]
    both = halves[0].withColumnRenamed("sketch", "x").join(halves[1], "g").select(sketch.merge(F.col("x"), F.col("sketch")).alias("m")).head()["m"]
    assert parts == both and len(parts) == sketch.K and parts == sorted(parts)


def test_edited_texts_by_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, D, "documents").collect())[::-1]
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, D).collect()}
    for i, (k, t) in enumerate(rows):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + rows[(i + 1) % len(rows)][1][:cut]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        assert 0 <= got[k]["near_next"] <= 1 and (got[k]["fingerprint"] == got[k]["edited_fingerprint"]) <= (got[k]["near_edited"] == 1)
    assert sum(r["near_edited"] for r in got.values()) > 5 * sum(r["near_next"] for r in got.values())


def test_sketch_rows(spark, odd):
    rows = sketch.edit_likeness(odd).collect()
    assert len(rows) == odd.count() and all(r["near_edited"] is not None for r in rows)
    assert sketch.edit_likeness(odd.where("false")).count() == 0
    one = sketch.edit_likeness(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).head()
    assert one["edited"] == "abcdab"


def frames_match(spark, name, tables, d=D):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, d).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    key = lambda f: sorted(map(str, f[cols].astype(object).itertuples(index=False, name=None)))
    assert key(ours) == key(theirs)


@pytest.mark.parametrize(("name", "tables"), [("op1_mixing", ["documents"]), ("op2_nearest", ["embeddings"]), ("op10_lm_scores", ["documents"])])
def test_matches_sql(spark, name, tables):
    frames_match(spark, name, tables)


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 5), ("d1", "en", "d", 1000)], "domain string, language string, source_name string, n_tokens long")
    got = {r["source_name"]: r["budget"] for r in mixing.budgets(leaves, 0.5, 1).collect()}
    half = (10 + 1000 + 5 + 1000) * 0.5 / 2
    assert got["a"] == 10 and got["c"] == 5 and got["b"] == int(half - 15) and got["d"] == int(half)
    short = {r["source_name"]: r["budget"] for r in mixing.budgets(leaves.where("source_name <> 'b'"), 0.5, 1).collect()}
    assert short["a"] == 10 and short["c"] == 5 and short["d"] == 492
    weighted = {r["source_name"]: r["budget"] for r in mixing.budgets(leaves, 0.1, 1, {"domain": {"d1": 3}}).collect()}
    assert weighted["d"] == 151


def test_mixing_fills_budgets_to_the_token(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    m = mixing.mix(docs, budget_share=0.5, max_epochs=3)
    leaf = mixing.budgets(docs.select(mixing.domain_of("source").alias("domain"), F.col("lang").alias("language"), F.col("source").alias("source_name"), mixing.token_count("text").alias("t")).groupBy("domain", "language", "source_name").agg(F.sum("t").alias("n_tokens")), 0.5, 3)
    want = {r["source_name"]: r["budget"] for r in leaf.collect()}
    got = {r["source_name"]: r["b"] for r in m.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("copies") + F.col("partial_tokens")).alias("b")).collect()}
    assert got == want and m.groupBy("source_name").agg(F.count_if(F.col("partial_tokens") > 0).alias("n")).where("n > 1").count() == 0


def test_mixing_of_wide_leaves_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 2}") for i in range(400)], "doc_id long, text string, lang string, source string")
    plain = sorted(map(str, mixing.mix(docs, budget_share=0.7).collect()))
    monkeypatch.setattr(mixing, "WIDE_LEAF", 10)
    assert sorted(map(str, mixing.mix(docs, budget_share=0.7).collect())) == plain and len(plain) > 100


def test_mixing_rows(spark, odd):
    rows = mixing.mix(odd, budget_share=1.0).collect()
    assert all(r["tokens"] > 0 for r in rows) and {r["doc_id"] for r in rows} <= {None, 6, 7, 8}
    assert mixing.mix(odd.where("false")).count() == 0


def test_nearest_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 5.0]), (9, [1.0, 0.0, 3.0]), (None, [9.0, 9.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("asks", F.lit("x"))
    got = ann.nearest(df.where("vec_id % 20 = 0"), df, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2.0), (0, 2, 2.0), (0, 20, 0.0), (20, 8, 5.0), (20, 0, 0.0), (20, 1, 0.0)]
    assert ann.nearest(df.where("false"), df).count() == 0


def test_tiles_bound_and_recompute():
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(150, 16)), np.concatenate([rng.normal(size=(500, 16)), np.ones((400, 16))])
    qid, cid = np.arange(150), np.arange(100, 1000)
    score = q @ c.T
    for i, best in ann.cell_nearest(qid, q, cid, c, 7):
        ok = cid != i
        want = sorted(zip(-np.round(score[i][ok], 9), cid[ok], strict=True))[:7]
        assert [round(s, 9) for s, _ in best] == pytest.approx([-s for s, _ in want])


def test_lm_rows(spark, odd):
    rows = {r["doc_id"]: r for r in ngram_lm.score(odd).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["per_word"] is None and rows[6]["n_words"] == 20000
    assert ngram_lm.score(odd.where("false")).count() == 0
    large = spark.createDataFrame([(2**60 + i if i else None, "a b") for i in range(5)], "doc_id long, text string")
    assert {r["doc_id"] for r in ngram_lm.score(large).collect()} == {None, *(2**60 + i for i in range(1, 5))}


def test_lm_of_higher_order_by_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(9)
    texts = [[rng.choice("a b c".split()) for _ in range(rng.randint(0, 30))] for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = Counter(tuple(t[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = sum(map(len, texts))

    def word(t, i):
        top = min(3, i + 1)
        for n in range(top, 1, -1):
            g = tuple(t[i - n + 1 : i + 1])
            if counts[g] >= 2:
                return math.log10(counts[g] / counts[g[:-1]]) + (top - n) * math.log10(ngram_lm.ALPHA)
        return math.log10(counts[(t[i],)] / total) + (top - 1) * math.log10(ngram_lm.ALPHA)

    got = {r["doc_id"]: r["log10_score"] for r in ngram_lm.score(df, order=3).collect()}
    assert got == pytest.approx({i: sum(word(t, j) for j in range(len(t))) for i, t in enumerate(texts)})


@pytest.mark.parametrize(("order", "least"), [(1, 2), (2, 2), (2, 1), (4, 3)])
def test_lm_equals_its_sql(spark, order, least):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(ngram_lm.oracle_sql(order, least)).fetchall()}
    for r in ngram_lm.score(table(spark, D, "documents"), order=order, least=least).collect():
        n, backed, v, per = want[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"]) == (n, backed) and r["log10_score"] == pytest.approx(v, abs=2e-6) and (per is None) == (r["per_word"] is None)


def test_texts_beyond_a_step(spark, monkeypatch):
    """Long texts are taken apart in steps, and many blocks and buckets talk to each other: the same scores."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") for _ in range(40))) for i in range(60)], "doc_id long, text string")
    plain = {r["doc_id"]: r["log10_score"] for r in ngram_lm.score(df).collect()}
    monkeypatch.setattr(ngram_lm, "STEP_CHARS", 50)
    monkeypatch.setattr(ngram_lm.packed, "BLOCK_CHARS", 100)
    monkeypatch.setattr(ngram_lm.packed, "BUCKET_HASHES", 20)
    assert {r["doc_id"]: r["log10_score"] for r in ngram_lm.score(df).collect()} == pytest.approx(plain)


def test_lm_counts_go_beyond_32_bits(spark, monkeypatch):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(30))) for i in range(20)], "doc_id long, text string")
    want = {r["doc_id"]: (r["n_backoff"], round(r["log10_score"], 9)) for r in ngram_lm.score(df).collect()}
    real = ngram_lm._counted

    def many(texts, order):
        h, n = real(texts, order)
        return h, n << 31

    monkeypatch.setattr(ngram_lm, "_counted", many)  # as if each text came 2^31 times: shares stay
    got = {r["doc_id"]: (r["n_backoff"], round(r["log10_score"], 9)) for r in ngram_lm.score(df, least=2 << 31).collect()}
    assert got == want
