"""Counts over a tree of blocks are those of one task for each bucket."""

import random

import numpy as np
import pytest

from quillon.llm import ngram_lm, packed, suffixes


@pytest.mark.parametrize("most", [2, 5])
def test_tree_totals_by_brute_force(spark, monkeypatch, most):
    rng = random.Random(most)
    asked, total = [], {}
    for block in range(40):
        for bucket in range(3):
            own = sorted({7, *(rng.randrange(60) for _ in range(rng.randint(0, 9)))} if bucket else {rng.randrange(10**6)})
            counts = [rng.randint(1, 900) for _ in own]
            for h, n in zip(own, counts, strict=True):
                total[bucket, h] = total.get((bucket, h), 0) + n
            if rng.random() < 0.9 or not bucket:
                asked.append((bucket, block, own, counts))
            else:
                for h, n in zip(own, counts, strict=True):
                    total[bucket, h] -= n
    rows = [(b, k, packed.pack(np.array(h, np.uint64)), packed.pack(np.array(n, np.uint32))) for b, k, h, n in asked]
    df = spark.createDataFrame(rows, "bucket int, block int, hashes binary, counts binary")
    monkeypatch.setattr(packed, "MOST_BLOCKS", most)
    for kind in (np.uint32, np.uint16):
        top = np.iinfo(kind).max
        got = {(r["bucket"], r["block"]): packed.unpack(r["totals"], kind).tolist() for r in packed.totals(df, kind, blocks=40).collect()}
        assert got == {(b, k): [min(total[b, x], top) for x in h] for b, k, h, _ in asked}


def test_scores_and_repeats_are_the_same_over_a_tree(spark, monkeypatch):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(packed, "BLOCK_CHARS", 400)
    both = []
    for most in (10**6, 4):
        monkeypatch.setattr(packed, "MOST_BLOCKS", most)
        both.append((sorted(map(str, ngram_lm.score(df).collect())), sorted(map(str, suffixes.repeated_spans(df).collect()))))
    assert both[0] == both[1]
