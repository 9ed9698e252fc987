"""What is done to scores as pyspark.ml stages that persist, so that a stack is one PipelineModel."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import calibrate

EPS = 1e-6


class _Persisted(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters are all there is to save."""


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class ClassProbability(Transformer, HasInputCol, HasOutputCol, _Persisted):
    """The probability of class 1 from a vector of both, off 0 and 1."""

    def __init__(self, inputCol: str = "probability", outputCol: str = "score") -> None:  # noqa: N803
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.least(F.greatest(vector_to_array(F.col(self.getInputCol()))[1], F.lit(EPS)), F.lit(1 - EPS)))


class MeanScore(Transformer, HasInputCols, HasOutputCol, _Persisted):
    """The mean of several columns; null if one of them is."""

    def __init__(self, inputCols: list[str] | None = None, outputCol: str = "score") -> None:  # noqa: N803
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getInputCols()
        return df.withColumn(self.getOutputCol(), sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))


class _Mapped(HasInputCol, HasOutputCol):
    """kind: rank (among the values fitted), normal (the rank on the normal scale) or blended (weight x rank + the rest of the score)."""

    kind = _param("kind", "rank, normal or blended", TypeConverters.toString)
    weight = _param("weight", "weight of the rank where blended", TypeConverters.toFloat)
    most = _param("most", "quantiles that are kept, at most", TypeConverters.toInt)


class ScoreMap(Estimator, _Mapped, _Persisted):
    """Fits quantiles of a column, of any domain: the one it will be asked about, labels or not."""

    def __init__(self, inputCol: str = "score", outputCol: str = "score", kind: str = "blended", weight: float = 0.9, most: int = 200) -> None:  # noqa: N803
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, kind=kind, weight=weight, most=most)

    def _fit(self, df: DataFrame) -> ScoreMapModel:
        fitted = calibrate.QuantileMap.fit(df, [self.getInputCol()], self.getOrDefault(self.most))
        return self._copyValues(ScoreMapModel.of(fitted, self.getInputCol()))


class ScoreMapModel(Model, _Mapped, _Persisted):
    levels = _param("levels", "levels of the quantiles", TypeConverters.toListFloat)
    quantiles = _param("quantiles", "the quantiles", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="score", outputCol="score", kind="blended", weight=0.9)

    @classmethod
    def of(cls, fitted: calibrate.QuantileMap, column: str) -> ScoreMapModel:
        model = cls()
        return model._set(levels=fitted.levels, quantiles=fitted.quantiles[column], inputCol=column, outputCol=column)

    def _transform(self, df: DataFrame) -> DataFrame:
        column, kind = self.getInputCol(), self.getOrDefault(self.kind)
        fitted = calibrate.QuantileMap(self.getOrDefault(self.levels), {column: self.getOrDefault(self.quantiles)})
        made = {"rank": fitted.rank, "normal": fitted.normal, "blended": lambda c: calibrate.blended(fitted, c, self.getOrDefault(self.weight))}
        return df.withColumn(self.getOutputCol(), made[kind](column))


class LogitShift(Transformer, HasInputCol, HasOutputCol, _Persisted):
    """Moves logits so that `threshold` becomes a half."""

    threshold = _param("threshold", "the score that becomes a half", TypeConverters.toFloat)
    slope = _param("slope", "what logits are scaled by", TypeConverters.toFloat)

    def __init__(self, threshold: float = 0.5, slope: float = 1.0, inputCol: str = "score", outputCol: str = "score") -> None:  # noqa: N803
        super().__init__()
        self._set(threshold=threshold, slope=slope, inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), calibrate.logit_shift(F.col(self.getInputCol()), self.getOrDefault(self.threshold), self.getOrDefault(self.slope)))


class Finish(Transformer, HasInputCols, HasOutputCol, _Persisted):
    """The score within [0, 1]; the columns named, which stages before made, are dropped."""

    def __init__(self, inputCols: list[str] | None = None, outputCol: str = "score") -> None:  # noqa: N803
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        score = self.getOutputCol()
        return df.withColumn(score, F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))).drop(*self.getInputCols())
