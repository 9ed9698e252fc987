"""From token documents of hands to a score of their chunk: TF-IDF, two learners blended, mean pooling."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, VectorSlicer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.tokens import pooled
from quillon.plans.model import hand_blend, hand_weights
from quillon.plans.stages import ClassProbability, Finish

#: Terms that are kept at most, the most frequent; of these the first for the trees, whose cost grows with columns, not with what is in them.
TERMS, TREE_TERMS = 1 << 17, 512
#: Hands of a partition that learners go over, at most about: the trees hold a whole number for each of their terms of each hand.
PART_HANDS = 25_000


def fit(hands: DataFrame, doc: str = "doc", label: str = "label", chunk: str = "chunk_id", least: int = 3, strength: float = 1.0, terms: int = TERMS, tree_terms: int = TREE_TERMS, rounds: int = 40, depth: int = 5, seed: int = 0) -> PipelineModel:
    """A PipelineModel that adds `trees`, `linear` and their blend `score` to hands with token documents.

    Terms in `least` documents or more are weighed by count times
    ln((1 + n) / (1 + df)) + 1 and scaled to unit length, as sparse vectors. A
    hand weighs 1 over the hands of its chunk, so chunks weigh alike. The linear
    model's penalty is that of `strength` over the weighted sum of losses. A
    null document has no term.
    """
    rows = hand_weights(hands.withColumn(doc, F.coalesce(F.col(doc), F.lit(""))).withColumn("label", F.col(label).cast("double")), chunk)
    counts = Pipeline(stages=[RegexTokenizer(inputCol=doc, outputCol="__terms", pattern=r"\s+"), CountVectorizer(inputCol="__terms", outputCol="__tf", minDF=least, vocabSize=terms)]).fit(rows)
    counted = counts.transform(rows)
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(counted).idf.toArray() + 1.0
    size = len(idf)
    scaled = PipelineModel(stages=[ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="__tf", outputCol="__w"), Normalizer(p=2.0, inputCol="__w", outputCol="features"), VectorSlicer(inputCol="features", outputCol="__top", indices=list(range(min(tree_terms, size))))])
    # text is small in files and wide as vectors: partitions are made by rows, not by the bytes that were read
    n = -(-rows.count() // PART_HANDS)
    if n > 1:
        counted = counts.transform(rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism)))
    x = scaled.transform(counted).select("features", "__top", "weight", "label").persist()
    total = x.agg(F.sum("weight")).head()[0]
    named = lambda learner, n: learner.setWeightCol("weight").setProbabilityCol(f"__p_{n}").setRawPredictionCol(f"__r_{n}").setPredictionCol(f"__y_{n}")
    linear = named(LogisticRegression(maxIter=200, tol=1e-9, regParam=1.0 / (strength * total), standardization=False), "linear").fit(x)
    trees = named(GBTClassifier(featuresCol="__top", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed), "trees").fit(x)
    x.unpersist()
    gone = ["__terms", "__tf", "__w", "features", "__top", *(f"__{k}_{n}" for k in "pry" for n in ("linear", "trees"))]
    return PipelineModel(stages=[counts, scaled, linear, trees, ClassProbability(inputCol="__p_linear", outputCol="linear"), ClassProbability(inputCol="__p_trees", outputCol="trees"), Finish(inputCols=gone, outputCol="linear")])


def chunk_scores(model: PipelineModel, hands: DataFrame, doc: str = "doc", label: str = "label", chunk: str = "chunk_id", order: str = "hand_ix") -> DataFrame:
    """chunk, score, label: .6 of the trees' and .4 of the linear model's score of each hand, mean over the chunk's hands; the label of the first hand."""
    rows = model.transform(hands.withColumn(doc, F.coalesce(F.col(doc), F.lit(""))))
    return pooled(rows.withColumn("score", hand_blend("trees", "linear")), [chunk], "score", label, order)
