"""The pipeline's stages on small data, against plain versions of what each must do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import bpe, pii, queries
from quillon.session import table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, D, "documents"), []
    for name, f in cp.STAGES:
        f(spark, docs, D).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stage_columns(stages):
    assert len(cp.STAGES) == 5
    for df in stages[:-1]:
        assert tuple(df.columns) == cp.COLUMNS


def test_language_stage_keeps_clean(spark, stages):
    docs = table(spark, D, "documents")
    assert stages[0].count() == docs.where(F.col("text").rlike("\\p{L}")).count()
    assert stages[0].join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").where("lang <> l").count() <= 2


def test_dedup_stage_keeps_one_of_exact_copies(stages):
    texts = stages[0].select("text").distinct().count()
    assert stages[1].count() <= texts and stages[1].groupBy("text").count().where("count > 1").count() == 0
    first = stages[0].groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert stages[1].join(first, "doc_id", "left_anti").count() == 0


def test_pii_stage_redacts(stages):
    before, after = {r["doc_id"]: r["text"] for r in stages[1].collect()}, {r["doc_id"]: r for r in stages[2].collect()}
    assert set(before) == set(after)
    for k, t in before.items():
        assert after[k]["text"] == pii.redact(t, pii.find_spans(t)[1]) and after[k]["n_chars"] == len(after[k]["text"])
        assert not pii.base_spans(after[k]["text"])


def test_last_stage_encodes(stages):
    coder = bpe.coder(queries.tokenizer_path())
    want = sorted((r["doc_id"], coder.tokenizer.encode(r["text"], add_special_tokens=False).ids) for r in stages[3].collect())  # a document may come whole and cut
    got = stages[4].collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_matches_stages(spark, stages):
    got = cp.run(spark, D)
    assert got.count() == stages[4].count() and got.columns == stages[4].columns


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog sat", "en", "s", 23), (3, "the cat and the dog sat", "en", "s", 23), (None, "the dog and the cat ran", None, None, 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    for _, f in cp.STAGES:
        f(spark, docs, D).collect()
        f(spark, docs.where("false"), D).collect()


def test_mix_stage_fills_budgets_row_by_row(spark, monkeypatch):
    from quillon.llm import mixing

    monkeypatch.setattr(cp, "MIX_SHARE", 0.7)
    text = lambda i, n: "  ".join(f"w{i}x{j}" for j in range(n)) + " \t"
    rows = [(None, text(1, 30), "en", "a", 7), (None, text(2, 20), "en", "a", 7), (1, text(3, 9), "en", "a", 7), (1, text(4, 5), "fr", "b", 7), (1, text(4, 5), "fr", "b", 7)]
    rows += [(2, text(5, 4000), "fr", "long", 7)] + [(10 + i, text(10 + i, 3 + i), "de", "c", 7) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    used = mixing.mix(docs, budget_share=0.7, max_epochs=2, keep=cp.COLUMNS).collect()
    want = {}
    for r in used:
        leaf = (r["language"], r["source_name"])
        want[leaf] = want.get(leaf, 0) + r["copies"] * r["tokens"] + r["partial_tokens"]
    out, got, cuts = cp.mix_sources(spark, docs, D).collect(), {}, 0
    for r in out:
        leaf = (r["lang"], r["source"])
        got[leaf] = got.get(leaf, 0) + len(r["text"].split())
        whole = [t for k, t, la, so, _ in rows if k == r["doc_id"] and (la, so) == leaf and t.startswith(r["text"])]
        assert whole and (r["n_chars"] == 7 if r["text"] in whole else r["n_chars"] == len(r["text"]))
        cuts += r["text"] not in whole
    plan = {(r["language"], r["source_name"]): r["budget"] for r in mixing.budgets(docs.select(mixing.domain_of("source").alias("domain"), F.col("lang").alias("language"), F.col("source").alias("source_name"), mixing.token_count("text").alias("t")).groupBy(*mixing.LEVELS).agg(F.sum("t").alias("n_tokens")), 0.7, 2).collect()}
    assert got == want == {k: v for k, v in plan.items() if v} and cuts >= 1 and ("fr", "long") in got
    assert any(r["doc_id"] is None for r in out)
