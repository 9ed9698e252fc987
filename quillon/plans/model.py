"""Stacked classifiers over feature frames with Spark ML."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.ranks import running
from quillon.operators import calibrate as calibration
from quillon.operators import drift, metrics
from quillon.plans.stages import ClassProbability, Finish, LogitShift, MeanScore, ScoreMapModel
from quillon.plans.trees import ExtraTreesClassifier, ExtraTreesModel
from quillon.session import materialised

EPS = 1e-6
CONFIG = "columns array<string>, names array<string>, meta string, k int, seed int, calibrate boolean, threshold double, weight string, levels array<double>, quantiles array<double>, params string"
Settings = Mapping[str, Mapping[str, float]]


def learners(seed: int = 0, weight: str | None = None, params: Settings | None = None) -> dict:
    """Base learners by name; each reads `features` and `label`, and `weight` if named. params: what differs from the defaults, by learner."""
    own = {"weightCol": weight} if weight else {}
    given = lambda name, **usual: usual | dict((params or {}).get(name, {})) | own
    return {
        "gbt": GBTClassifier(seed=seed, **given("gbt", maxDepth=4, maxIter=20)),
        "forest": RandomForestClassifier(seed=seed, **given("forest", numTrees=50, maxDepth=8)),
        "extra": ExtraTreesClassifier(seed=seed, **given("extra", numTrees=50, maxDepth=8)),
        "linear": LogisticRegression(**given("linear", maxIter=100, regParam=0.01)),
    }


def prepare(columns: list[str]) -> Pipeline:
    """Median imputation and assembly into `features`."""
    filled = [f"__{c}" for c in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=0.0), VectorAssembler(inputCols=filled, outputCol="features")])


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with `fold`: each class is dealt in turn to the folds in the order of a hash of the key, so folds hold equal shares of it."""
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__one", F.lit(1))
    return running(hashed, [label], ["__h", key], {"__i": "__one"}).withColumn("fold", F.pmod(F.col("__i") - 1, F.lit(k)).cast("int")).drop("__h", "__one", "__i", "all___i")


def _probability(model, df: DataFrame, name: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    out = model.transform(df).withColumn(name, F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))
    return out.drop("probability", "rawPrediction", "prediction")


def _named(model, param: str, column: str):
    """A model whose column is named so; Spark's own take it by a setter."""
    setter = getattr(model, f"set{param[0].upper()}{param[1:]}", None)
    return setter(column) if setter else model._set(**{param: column})


class Stack:
    """Base learners, their out-of-fold scores, a logistic or mean meta learner, and what is done to its score.

    calibrate: blend the score with its rank among out-of-fold scores.
    threshold: shift logits so that this score becomes a half. weight: a column
    of row weights for the base learners. params: settings by learner.
    """

    def __init__(
        self,
        columns: list[str],
        names: tuple[str, ...] = ("gbt", "forest", "linear"),
        meta: str = "logistic",
        k: int = 5,
        seed: int = 0,
        calibrate: bool = False,
        threshold: float | None = None,
        weight: str | None = None,
        params: Settings | None = None,
    ) -> None:
        self.columns, self.names, self.kind, self.k, self.seed, self.weight, self.params = columns, names, meta, k, seed, weight, params
        self.calibrate, self.threshold, self.map = calibrate, threshold, None

    def fit(self, df: DataFrame, key: str, label: str = "label") -> Stack:
        """Every fold is scored by learners that did not see it; the meta learner and the calibration are fitted on those scores."""
        df = folds(df.withColumnRenamed(label, "label") if label != "label" else df, key, "label", self.k, self.seed)
        self.prepared = prepare(self.columns).fit(df)
        x = self.prepared.transform(df).persist()
        made = lambda: learners(self.seed, self.weight, self.params)
        if self.kind == "logistic" or self.calibrate:
            parts = None
            for fold in range(self.k):
                part = x.where(F.col("fold") == fold)
                for name in self.names:
                    part = _probability(made()[name].fit(x.where(F.col("fold") != fold)), part, name)
                part = part.select("label", *self.names)
                parts = part if parts is None else parts.unionByName(part)
            parts = materialised(parts)  # else each task of each step of the meta learner gets all models of all folds
            if self.kind == "logistic":
                self.meta = LogisticRegression(featuresCol="meta", maxIter=100).fit(VectorAssembler(inputCols=list(self.names), outputCol="meta").transform(parts))
            if self.calibrate:
                self.map = calibration.QuantileMap.fit(self._meta(parts), ["score"])
        self.models = {name: made()[name].fit(x) for name in self.names}
        x.unpersist()
        return self

    def refit(self, train: DataFrame, test: DataFrame, key: str, label: str = "label") -> Stack:
        """A stack of the same settings fitted on both: for serving, once the test rows have told what they can."""
        again = Stack(self.columns, self.names, self.kind, self.k, self.seed, self.calibrate, self.threshold, self.weight, self.params)
        return again.fit(train.unionByName(test), key, label)

    def recalibrate(self, df: DataFrame) -> Stack:
        """Fits the calibration on the scores of another domain, whose rows need no label."""
        self.calibrate, self.map = True, calibration.QuantileMap.fit(self._scored(df), ["score"])
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        out = self.prepared.transform(df)
        for name in self.names:
            out = _probability(self.models[name], out, name)
        return self._meta(out)

    def pipeline(self) -> PipelineModel:
        """The fitted stack as one PipelineModel, which saves, loads and scores without this class."""
        stages, gone = [self.prepared], ["features", *[f"__{c}" for c in self.columns]]

        def placed(model, name: str):
            own = model.copy()
            mine = {"probabilityCol": f"__p_{name}", "rawPredictionCol": f"__r_{name}", "predictionCol": f"__y_{name}"}
            for param, column in mine.items():
                if own.hasParam(param):
                    own = _named(own, param, column)
            gone.extend(mine.values())
            return own

        for name in self.names:
            stages += [placed(self.models[name], name), ClassProbability(inputCol=f"__p_{name}", outputCol=name)]
        if self.kind == "mean":
            stages.append(MeanScore(inputCols=list(self.names), outputCol="score"))
        else:
            stages += [VectorAssembler(inputCols=list(self.names), outputCol="meta"), placed(self.meta, "meta"), ClassProbability(inputCol="__p_meta", outputCol="score")]
            gone.append("meta")
        if self.map is not None:
            stages.append(ScoreMapModel.of(self.map, "score"))
        if self.threshold is not None:
            stages.append(LogitShift(threshold=self.threshold))
        return PipelineModel(stages=[*stages, Finish(inputCols=gone, outputCol="score")])

    def _meta(self, df: DataFrame) -> DataFrame:
        if self.kind == "mean":
            return df.withColumn("score", sum(F.col(n) for n in self.names) / len(self.names))
        return _probability(self.meta, VectorAssembler(inputCols=list(self.names), outputCol="meta").transform(df), "score").drop("meta")

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a score of each base learner and `score`, calibrated, shifted and within [0, 1]."""
        out = self._scored(df)
        if self.map is not None:
            out = out.withColumn("score", calibration.blended(self.map, "score"))
        if self.threshold is not None:
            out = out.withColumn("score", calibration.logit_shift(F.col("score"), self.threshold))
        return out.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).drop("features", *[f"__{c}" for c in self.columns])

    def save(self, path: str) -> None:
        """Every fitted part under a folder, and what they are in a JSON table."""
        self.prepared.write().overwrite().save(f"{path}/prepared")
        for name, m in self.models.items():
            m.write().overwrite().save(f"{path}/{name}")
        if self.kind == "logistic":
            self.meta.write().overwrite().save(f"{path}/meta")
        levels, quantiles = (self.map.levels, self.map.quantiles["score"]) if self.map else ([], [])
        row = (self.columns, list(self.names), self.kind, self.k, self.seed, self.calibrate, self.threshold, self.weight, levels, quantiles, json.dumps(self.params))
        SparkSession.active().createDataFrame([row], CONFIG).write.mode("overwrite").json(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Stack:
        c = spark.read.schema(CONFIG).json(f"{path}/config").head()
        out = cls(c["columns"], tuple(c["names"]), c["meta"], c["k"], c["seed"], c["calibrate"], c["threshold"], c["weight"], json.loads(c["params"] or "null"))
        kinds = {"gbt": GBTClassificationModel, "forest": RandomForestClassificationModel, "extra": ExtraTreesModel, "linear": LogisticRegressionModel}
        out.prepared = PipelineModel.load(f"{path}/prepared")
        out.models = {n: kinds[n].load(f"{path}/{n}") for n in out.names}
        if out.kind == "logistic":
            out.meta = LogisticRegressionModel.load(f"{path}/meta")
        if c["quantiles"]:
            out.map = calibration.QuantileMap(list(c["levels"]), {"score": list(c["quantiles"])})
        return out


def search(train: DataFrame, test: DataFrame, columns: list[str], key: str, day: str, ks_limits: list[float], grid: list[dict] | None = None) -> list[tuple[float, dict, int, float]]:
    """(ks limit, settings, columns kept, sel_score) of each limit and settings, best first: features under the limit, a stack on train, daily rewards on test.

    grid: settings of Stack; one mean stack of two learners if none is given.
    """
    found = []
    screened = drift.screen(train, columns).persist()
    for limit in ks_limits:
        kept = drift.select_features(columns, screened, ks_max=limit)
        for settings in (grid or [{"names": ("forest", "linear"), "meta": "logistic"}]) if kept else []:
            scored = Stack(kept, **settings).fit(train, key).transform(test)
            sel = metrics.stability(metrics.rewards(scored, [day], key)).head()["sel_score"]
            found.append((limit, settings, len(kept), sel if sel is not None else float("-inf")))
    screened.unpersist()
    return sorted(found, key=lambda x: -x[3])


def draws(space: Mapping[str, Sequence], n: int = 40, seed: int = 0) -> list[dict[str, dict]]:
    """n settings, all different, of a grid given as "learner.parameter": values; all of them, in the same shuffled order, if there are no more."""
    names = sorted(space)
    sizes = [len(space[k]) for k in names]
    total = math.prod(sizes)
    out = []
    for i in random.Random(seed).sample(range(total), min(n, total)):
        chosen: dict[str, dict] = {}
        for name, size in zip(names, sizes, strict=True):
            i, at = divmod(i, size)
            learner, parameter = name.split(".", 1)
            chosen.setdefault(learner, {})[parameter] = space[name][at]
        out.append(chosen)
    return out


def random_search(
    df: DataFrame,
    columns: list[str],
    key: str,
    day: str,
    from_day: str,
    space: Mapping[str, Sequence],
    n: int = 40,
    seed: int = 0,
    parallel: int = 4,
    **stack,
) -> list[tuple[dict, float]]:
    """(settings, sel_score), best first, of n draws from a grid: each a stack fitted on the days before a date, its daily rewards from that date on.

    `parallel` fits run at a time; every one is a job of the cluster, so this
    only keeps it busy. Days are split, not rows: no day is on both sides.
    """
    train, test = (part.persist() for part in time_split(df, day, from_day))
    train.count()

    def score(params: dict) -> tuple[dict, float]:
        scored = Stack(columns, params=params, seed=seed, **stack).fit(train, key).transform(test)
        sel = metrics.stability(metrics.rewards(scored, [day], key)).head()["sel_score"]
        return params, sel if sel is not None else float("-inf")

    with ThreadPoolExecutor(parallel) as pool:
        found = list(pool.map(score, draws(space, n, seed)))
    train.unpersist()
    test.unpersist()
    return sorted(found, key=lambda x: -x[1])


def importances(stack: Stack, name: str = "gbt", k: int = 20) -> list[str]:
    """The k most important columns of a tree learner."""
    weights = stack.models[name].featureImportances.toArray()
    return [stack.columns[i] for i in weights.argsort()[::-1][:k]]


def pseudo_labels(scored: DataFrame, high: float = 0.9, low: float = 0.1) -> DataFrame:
    """Rows whose score is sure, with the label that it tells."""
    return scored.where((F.col("score") > high) | (F.col("score") < low)).withColumn("label", (F.col("score") > high).cast("int"))


def time_split(df: DataFrame, day: str, from_day: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a date and from it on, dates compared as text."""
    return df.where(F.col(day) < from_day), df.where(F.col(day) >= from_day)


def hand_weights(hands: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """hands with `weight`: 1 over the hands of the chunk, so that every chunk weighs alike."""
    sizes = hands.groupBy(chunk).agg((1.0 / F.count("*")).alias("weight"))
    return hands.join(sizes, chunk)


def hand_blend(trees: str = "gbt", linear: str = "linear"):
    """.6 of the trees' score and .4 of the linear one's."""
    return 0.6 * F.col(trees) + 0.4 * F.col(linear)
