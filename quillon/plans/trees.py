"""Extremely randomised trees: random thresholds, grown level by level for all trees at once.

A level costs one aggregate over the rows, whatever the number of trees: each
partition sends rows down the trees so far and adds up, for each open node, the
weights of both classes on the left of each of its random splits. Sums are
combined level by level; the driver sees numbers that depend on the size of the
trees, not on the rows, and picks each node's best split.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, feature array<int>, threshold array<double>, value array<double>, gain array<double>"


class _Columns(HasFeaturesCol, HasLabelCol, HasWeightCol, HasProbabilityCol, HasPredictionCol, HasSeed):
    """Columns that learner and model share."""


class Forest:
    """Trees as arrays by heap number (children of i are 2i + 1 and 2i + 2); feature -1 is a leaf."""

    def __init__(self, trees: int, depth: int) -> None:
        nodes = (2 << depth) - 1
        self.depth = depth
        self.feature = np.full((trees, nodes), -1, np.int32)
        self.threshold, self.value, self.gain = (np.zeros((trees, nodes)) for _ in range(3))

    def place(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                break
            left = x[row, np.maximum(f, 0)] <= self.threshold[tree, at]
            at = np.where(inner, 2 * at + 2 - left, at)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([self.value[t, self.place(t, x)] for t in range(len(self.feature))], axis=0) if len(x) else np.zeros(0)


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)] if a and b else a or b


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class ExtraTreesClassifier(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Binary classifier (label 0 or 1) over dense or sparse `features`. Every tree sees all rows.

    Each open node draws `candidates` features (the root of their number, if 0)
    and for each one threshold within the range that the feature can have there;
    the split with the largest fall of Gini impurity is taken, if both sides
    have `minRows`. Draws depend on seed, tree and node alone.
    """

    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", typeConverter=TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "rows on each side of a split, at least", typeConverter=TypeConverters.toInt)
    candidates = Param(Params._dummy(), "candidates", "splits drawn for a node, 0 for the root of the number of features", typeConverter=TypeConverters.toInt)

    def __init__(self, numTrees: int = 50, maxDepth: int = 8, minRows: int = 1, candidates: int = 0, seed: int = 0, weightCol: str | None = None, featuresCol: str = "features", labelCol: str = "label") -> None:  # noqa: N803
        super().__init__()
        self._set(numTrees=numTrees, maxDepth=maxDepth, minRows=minRows, candidates=candidates, seed=seed, featuresCol=featuresCol, labelCol=labelCol)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        weight = F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1.0)
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.cast("double").alias("w"))
        low, high = self._ranges(rows)
        n_trees, depth, seed, least = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.seed, self.minRows))
        m = self.getOrDefault(self.candidates) or max(1, round(math.sqrt(len(low))))
        forest = Forest(n_trees, depth)
        nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(t, 0): (low, high) for t in range(n_trees)}  # open nodes and the ranges there
        for level in range(depth + 1):
            draws = {k: self._draw(seed, *k, *r, m) for k, r in nodes.items()} if level < depth else {k: (np.zeros(0, np.int64), np.zeros(0)) for k in nodes}
            total, left = self._sums(rows, forest, draws, len(low), m if level < depth else 0)
            grown: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for i, (key, (feature, threshold)) in enumerate(draws.items()):
                both, weights = total[i], total[i][:2].sum()
                forest.value[key] = both[1] / weights if weights else 0.5
                best = self._best(both, left[i], least) if level < depth else None
                if best is None:
                    continue
                j, gain = best
                forest.feature[key], forest.threshold[key], forest.gain[key] = feature[j], threshold[j], gain
                for side, child in enumerate((2 * key[1] + 1, 2 * key[1] + 2)):
                    lo, hi = (r.copy() for r in nodes[key])
                    (lo if side else hi)[feature[j]] = threshold[j]
                    grown[key[0], child] = (lo, hi)
            nodes = grown
            if not nodes:
                break
        return self._copyValues(ExtraTreesModel(forest, len(low)))

    @staticmethod
    def _ranges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value of each feature, a row of both for each partition on the way."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most: np.ndarray | None = None
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), len(b.column(0)[0]))
                    own = np.stack([np.nanmin(x, 0), np.nanmax(x, 0)])
                    most = own if most is None else np.stack([np.minimum(most[0], own[0]), np.maximum(most[1], own[1])])
            if most is not None:
                yield pa.RecordBatch.from_pydict({"r": [pickle.dumps(most)]})

        found = rows.select("x").mapInArrow(part, "r binary").rdd.map(lambda r: pickle.loads(r["r"]))
        meet = lambda a, b: b if a is None else a if b is None else np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1])])
        both = found.treeAggregate(None, meet, meet)
        if both is None:
            raise ValueError("there is no row to learn from")
        return both[0], both[1]

    @staticmethod
    def _draw(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, tree, node])
        able = np.flatnonzero(high > low)
        if not len(able):
            able = np.zeros(1, np.int64)
        feature = rng.choice(able, size=m, replace=len(able) < m)
        return feature, low[feature] + rng.random(m) * (high[feature] - low[feature])

    @staticmethod
    def _sums(rows: DataFrame, forest: Forest, draws: dict, width: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each open node: weights of class 0 and 1 and rows, in all and on the left of each split drawn."""
        slot = np.full(forest.feature.shape, -1, np.int64)
        for i, key in enumerate(draws):
            slot[key] = i
        n = len(draws)
        features = np.array([d[0] for d in draws.values()], np.int64).reshape(n, m)
        thresholds = np.array([d[1] for d in draws.values()]).reshape(n, m)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, left = np.zeros((n, 3)), np.zeros((n, m, 3))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, w = _matrix(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy()
                parts = (w * (y <= 0), w * (y > 0), np.ones(len(y)))
                for t in range(len(slot)):
                    own = slot[t, forest.place(t, x)]
                    open_ = np.flatnonzero(own >= 0)
                    if not len(open_):
                        continue
                    own = own[open_]
                    for k, v in enumerate(parts):
                        total[:, k] += np.bincount(own, v[open_], n)
                    for j in range(m):
                        goes = x[open_, features[own, j]] <= thresholds[own, j]
                        for k, v in enumerate(parts):
                            left[:, j, k] += np.bincount(own[goes], v[open_[goes]], n)
            yield pa.RecordBatch.from_pydict({"s": [pickle.dumps([total, left])]})

        found = rows.mapInArrow(part, "s binary").rdd.map(lambda r: pickle.loads(r["s"])).treeAggregate([], _add, _add)
        return (found[0], found[1]) if found else (np.zeros((n, 3)), np.zeros((n, m, 3)))

    @staticmethod
    def _best(total: np.ndarray, left: np.ndarray, least: int) -> tuple[int, float] | None:
        """The split with the largest fall of impurity, and the fall in weight; None if none splits."""
        right = total - left
        impurity = lambda s: 2 * s[..., 0] * s[..., 1] / np.maximum(s[..., 0] + s[..., 1], 1e-300)
        gain = impurity(total) - impurity(left) - impurity(right)
        gain[(left[:, 2] < least) | (right[:, 2] < least)] = -1
        j = int(gain.argmax())
        return (j, float(gain[j])) if gain[j] > 1e-12 * max(1.0, float(total[:2].sum())) else None


class ExtraTreesModel(Model, _Columns, MLWritable, MLReadable):
    """Adds `probability` (a vector) and `prediction`."""

    def __init__(self, forest: Forest | None = None, width: int = 0) -> None:
        super().__init__()
        self.forest, self.width = forest, width

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Share of each feature in all falls of impurity."""
        inner = self.forest.feature >= 0
        gains = np.bincount(self.forest.feature[inner], self.forest.gain[inner], self.width)
        return DenseVector(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        forest, width = self.forest, self.width

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(forest.score(np.stack(x.to_numpy()).astype(np.float64).reshape(-1, width))) if len(x) else pd.Series([], dtype="float64")

        p = df.withColumn("__p", score(vector_to_array(F.col(self.getFeaturesCol()))))
        p = p.withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))))
        return p.withColumn(self.getPredictionCol(), (F.col("__p") > 0.5).cast("double")).drop("__p")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ExtraTreesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        f, spark = self.model.forest, SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"width": self.model.width, "depth": f.depth})
        rows = [(t, f.feature[t].tolist(), f.threshold[t].tolist(), f.value[t].tolist(), f.gain[t].tolist()) for t in range(len(f.feature))]
        spark.createDataFrame(rows, NODES).write.parquet(f"{path}/data")


class _ForestReader(MLReader):
    def load(self, path: str) -> ExtraTreesModel:
        spark = SparkSession.active()
        about = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/data").orderBy("tree").collect()  # a row for each tree
        forest = Forest(len(rows), int(about["depth"]))
        for r in rows:
            forest.feature[r["tree"]], forest.threshold[r["tree"]], forest.value[r["tree"]], forest.gain[r["tree"]] = r["feature"], r["threshold"], r["value"], r["gain"]
        model = ExtraTreesModel(forest, int(about["width"]))
        DefaultParamsReader.getAndSetParams(model, about)
        return model
