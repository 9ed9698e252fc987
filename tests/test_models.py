"""Extra-trees, stacks as one PipelineModel, the hand text model, random search."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillon.operators import metrics
from quillon.plans import handtext, model
from quillon.plans.stages import LogitShift, ScoreMap, ScoreMapModel
from quillon.plans.trees import ExtraTreesClassifier, ExtraTreesModel, Forest


def labelled(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i]), f"2026-01-{1 + i % 8:02d}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int, day string")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


def probability(out):
    return {r["id"]: r["probability"][1] for r in out.select("id", "probability").collect()}


def ap(out, score="score"):
    return metrics.average_precision(out.withColumn("all", F.lit(1)).select("all", F.col(score).alias("score"), "label"), ["all"]).head()["ap"]


def test_extra_trees_learn_save_and_load(spark, tmp_path):
    df = labelled(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    fitted = ExtraTreesClassifier(numTrees=40, maxDepth=8, candidates=4, seed=3).fit(train)
    again = ExtraTreesClassifier(numTrees=40, maxDepth=8, candidates=4, seed=3).fit(train.repartition(7))
    assert probability(fitted.transform(test)) == pytest.approx(probability(again.transform(test)))  # draws depend on no partition
    out = fitted.transform(test).withColumn("score", model.vector_to_array("probability")[1])
    forest = model.learners(3)["forest"].fit(train).transform(test).withColumn("score", model.vector_to_array("probability")[1])
    assert ap(out) > 0.85 and ap(out) > ap(forest) - 0.05
    weights = fitted.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and min(weights[:2]) > max(weights[2:])
    fitted.write().overwrite().save(str(tmp_path / "m"))
    assert probability(ExtraTreesModel.load(str(tmp_path / "m")).transform(test)) == probability(fitted.transform(test))


def test_sums_of_a_level_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 2, 60).astype(float), rng.integers(1, 4, 60).astype(float)
    rows = spark.createDataFrame([(x[i].tolist(), float(y[i]), float(w[i])) for i in range(60)], "x array<double>, y double, w double").repartition(3)
    forest = Forest(2, 2)
    forest.feature[1, 0], forest.threshold[1, 0] = 2, 0.1
    draws = {(0, 0): (np.array([0, 1]), np.array([0.0, 0.3])), (1, 2): (np.array([1, 1]), np.array([-0.2, 5.0]))}
    total, left = ExtraTreesClassifier._sums(rows, forest, draws, 3, 2)
    for i, ((tree, _), (features, thresholds)) in enumerate(draws.items()):
        own = np.ones(60, bool) if tree == 0 else x[:, 2] > 0.1
        assert total[i].tolist() == [w[own & (y == 0)].sum(), w[own & (y == 1)].sum(), own.sum()]
        for j in range(2):
            goes = own & (x[:, features[j]] <= thresholds[j])
            assert left[i, j].tolist() == [w[goes & (y == 0)].sum(), w[goes & (y == 1)].sum(), goes.sum()]


def test_extra_trees_on_odd_rows(spark):
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "id long, a double, label int")
    same = VectorAssembler(inputCols=["a"], outputCol="features").transform(same)
    assert set(probability(ExtraTreesClassifier(numTrees=3).fit(same).transform(same)).values()) == {0.5}
    one = ExtraTreesClassifier(numTrees=3).fit(same.where("label = 1")).transform(same)
    assert set(probability(one).values()) == {1.0}
    heavy = ExtraTreesClassifier(numTrees=3, weightCol="w").fit(same.withColumn("w", 1.0 + 2 * F.col("label"))).transform(same)
    assert set(probability(heavy).values()) == {0.75}
    with pytest.raises(ValueError, match="no row"):
        ExtraTreesClassifier().fit(same.where("false"))


def test_extra_trees_keep_up_with_the_forest_on_documents(spark, sf):
    from quillon.session import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").join(table(spark, "/root/testdata/sf0.01", "labels").where("quality is not null"), "doc_id")
    text, words = F.coalesce("text", F.lit("")), F.split(F.coalesce("text", F.lit("")), r"\s+")
    x = docs.select(F.col("doc_id").alias("id"), F.log1p(F.length(text)).alias("a"), (F.size(F.array_distinct(words)) / F.size(words)).alias("b"), (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))).alias("c"), F.col("quality").alias("label"))
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(x).persist()
    train, test = x.where("id % 3 <> 0"), x.where("id % 3 = 0")
    score = lambda name: ap(model.learners(0)[name].fit(train).transform(test).withColumn("score", model.vector_to_array("probability")[1]))
    assert score("extra") >= score("forest") - 0.02
    x.unpersist()


def test_the_meta_learner_reads_scores_that_are_written(spark, monkeypatch):
    """Else each of its steps runs over the plans of all folds, whose tasks bring all models along."""
    plans, fit = [], model.LogisticRegression.fit

    def spy(self, df, *rest):
        if self.getFeaturesCol() == "meta":
            plans.append(df._jdf.queryExecution().analyzed().toString())
        return fit(self, df, *rest)

    monkeypatch.setattr(model.LogisticRegression, "fit", spy)
    df = labelled(spark, 120).drop("features")
    model.Stack(["a", "b"], names=("forest", "linear"), k=3, params={"forest": {"numTrees": 3}}).fit(df, "id")
    assert len(plans) == 1 and "Union" not in plans[0] and "probability" not in plans[0]


@pytest.mark.parametrize("meta", ["logistic", "mean"])
def test_a_stack_is_one_pipeline_model(spark, tmp_path, meta):
    df = labelled(spark, 200).drop("features")
    stack = model.Stack(["a", "b"], names=("forest", "extra", "linear"), meta=meta, k=2, calibrate=True, threshold=0.4, params={"forest": {"numTrees": 5}, "extra": {"numTrees": 5}}).fit(df, "id")
    want = {r["id"]: r["score"] for r in stack.transform(df).collect()}
    made = stack.pipeline()
    made.write().overwrite().save(str(tmp_path / "p"))
    out = PipelineModel.load(str(tmp_path / "p")).transform(df)
    assert {r["id"]: r["score"] for r in out.collect()} == pytest.approx(want, abs=1e-12)
    assert set(out.columns) == {*df.columns, "forest", "extra", "linear", "score"}
    stack.save(str(tmp_path / "s"))
    assert {r["id"]: r["score"] for r in model.Stack.load(spark, str(tmp_path / "s")).transform(df).collect()} == pytest.approx(want, abs=1e-12)
    other = df.withColumn("a", F.col("a") * 3 + 1)
    ranks = [r["score"] for r in stack.recalibrate(other).transform(other).collect()]
    assert len(ranks) == 200 and stack.map is not None


@pytest.mark.parametrize("kind", ["rank", "normal", "blended"])
def test_score_maps_are_fitted_on_a_domain_of_their_own_and_persist(spark, tmp_path, kind):
    domain = spark.createDataFrame([(i / 100,) for i in range(101)], "score double")
    asked = spark.createDataFrame([(0, -1.0), (1, 0.25), (2, 0.5), (3, 2.0), (4, None)], "id int, score double")
    fitted = ScoreMap(kind=kind).fit(domain)
    assert fitted.getOrDefault("kind") == kind
    got = [r["score"] for r in fitted.transform(asked).orderBy("id").collect()]
    want = {"rank": [0.0, 0.25, 0.5, 1.0, None], "blended": [0.0, 0.25, 0.5, 1.0, 0.0]}
    if kind in want:
        assert got == pytest.approx(want[kind])
    else:
        assert got[0] == pytest.approx(-5.2, abs=0.01) and got[1] == pytest.approx(-0.6745, abs=1e-3) and got[2] == pytest.approx(0, abs=1e-9)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    assert [r["score"] for r in ScoreMapModel.load(str(tmp_path / "m")).transform(asked).orderBy("id").collect()] == got
    LogitShift(0.25).write().overwrite().save(str(tmp_path / "l"))
    assert LogitShift.load(str(tmp_path / "l")).transform(asked.where("id = 1")).head()["score"] == pytest.approx(0.5)


def test_draws_are_the_same_in_each_run():
    space = {"gbt.maxDepth": [2, 3, 4], "gbt.maxIter": [10, 20, 30, 40], "forest.numTrees": [20, 50, 100], "forest.maxDepth": [4, 6, 8, 10], "linear.regParam": [0.001, 0.01, 0.1]}
    a, b = model.draws(space, 40, 7), model.draws(space, 40, 7)
    assert a == b and len(a) == 40 and len({str(x) for x in a}) == 40 and a != model.draws(space, 40, 8)
    assert len(model.draws({"gbt.maxDepth": [2, 3]}, 40)) == 2 and a[0].keys() == {"gbt", "forest", "linear"}


def test_random_search_splits_by_day(spark):
    df = labelled(spark, 240).drop("features")
    found = model.random_search(df, ["a", "b", "c", "d"], "id", "day", "2026-01-06", {"forest.maxDepth": [1, 6], "forest.numTrees": [10]}, n=2, names=("forest",), meta="mean", k=2)
    assert [p["forest"]["maxDepth"] for p, _ in found] == [6, 1] and found[0][1] > found[1][1]
    train, test = model.time_split(df, "day", "2026-01-06")
    assert not {r[0] for r in train.select("day").distinct().collect()} & {r[0] for r in test.select("day").distinct().collect()}


def hands_with_documents(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        label = c % 2
        for h in range(rng.randint(1, 12)):
            words = [rng.choice(["pF0", "fB1", "tC2", "rX0", "pR3"]) for _ in range(rng.randint(0, 6))] + (["sure"] if label and rng.random() < 0.5 else []) + (["not"] if not label and rng.random() < 0.4 else [])
            rows.append((c, h, " ".join(words) or None, label))
    return rows, spark.createDataFrame(rows, "chunk_id long, hand_ix int, doc string, label int")


def test_learners_of_hand_texts_go_over_partitions_of_bounded_rows(spark, monkeypatch):
    """Documents are small in files, so that reading them makes few partitions, which are wide once they are vectors."""
    most, columns, fit = [], [], handtext.GBTClassifier.fit

    def spy(self, df, *rest):
        most.append(max(df.rdd.glom().map(len).collect()))
        columns.append(set(df.columns))
        return fit(self, df, *rest)

    monkeypatch.setattr(handtext.GBTClassifier, "fit", spy)
    monkeypatch.setattr(handtext, "PART_HANDS", 40)
    handtext.fit(hands_with_documents(spark)[1].coalesce(1), rounds=1, depth=2)
    assert most[0] <= 60 and columns[0] == {"features", "__top", "weight", "label"}


def test_hand_text_model_against_a_plain_logistic_fit(spark, tmp_path):
    rows, df = hands_with_documents(spark)
    fitted = handtext.fit(df, rounds=5, depth=3)
    out = {(r["chunk_id"], r["hand_ix"]): r for r in fitted.transform(df.withColumn("doc", F.coalesce("doc", F.lit("")))).collect()}
    docs = [(d or "").lower().split() for _, _, d, _ in rows]
    df_n = {t: sum(t in d for d in docs) for t in {t for d in docs for t in d}}
    vocab = [t for t, n in df_n.items() if n >= 3]
    x = np.array([[d.count(t) * (np.log((1 + len(docs)) / (1 + df_n[t])) + 1) for t in vocab] for d in docs])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y, sizes = np.array([r[3] for r in rows], float), {}
    for c, *_ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    w = np.array([1 / sizes[r[0]] for r in rows])
    a, beta = np.c_[x, np.ones(len(x))], np.zeros(len(vocab) + 1)
    ridge = np.diag([1.0] * len(vocab) + [0.0])
    for _ in range(50):  # Newton steps of sum w loss + |b|^2 / 2
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve(a.T @ ((w * p * (1 - p))[:, None] * a) + ridge, a.T @ (w * (p - y)) + ridge @ beta)
    want = 1 / (1 + np.exp(-a @ beta))
    assert [out[r[0], r[1]]["linear"] for r in rows] == pytest.approx(want.tolist(), abs=1e-4)
    assert set(out[0, 0].asDict()) == {"chunk_id", "hand_ix", "doc", "label", "linear", "trees"}
    chunks = {r["chunk_id"]: r for r in handtext.chunk_scores(fitted, df).collect()}
    mean = np.mean([0.6 * out[r[0], r[1]]["trees"] + 0.4 * out[r[0], r[1]]["linear"] for r in rows if r[0] == 7])
    assert chunks[7]["score"] == pytest.approx(mean) and chunks[7]["label"] == 1 and len(chunks) == 60
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = handtext.chunk_scores(PipelineModel.load(str(tmp_path / "m")), df).collect()
    assert {r["chunk_id"]: r["score"] for r in again} == pytest.approx({c: r["score"] for c, r in chunks.items()})
