"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann, bpe, clustering, divergence, exact, langid, mixing, ngram_lm, pii, secrets, simhash, sketch, suffixes
from quillon.session import table


#: Tokenizer file of the BPE queries, on every machine.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=mixing.TARGETS)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edit_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.written(F.col("sketch")).alias("fingerprint"),
        sketch.written(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.round(sketch.distinct_shingles(F.col("sketch")), 3).alias("n_shingles"),
        F.round(sketch.containment(F.col("sketch"), F.col("edited_sketch")), 6).alias("contained"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in secrets.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(table(spark, sf_dir, "documents"))
    return found.withColumn("log10_score", F.round("log10_score", 6)).withColumn("per_word", F.round("per_word", 6))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                 AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
      FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 20 = 0) q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 20"""

QUERIES = {f.__name__: f for f in (op1_mixing, op2_nearest, op3_repeats, op4_simhash, op5_fingerprints, op6_bpe, op7_secrets, op8_language_id, op9_pii, op10_lm_scores, op11_divergence, op12_clustering, op13_exact)}
ORACLES: dict[str, str] = {"op1_mixing": mixing.oracle_sql(weights=mixing.TARGETS), "op2_nearest": OP2_SQL, "op10_lm_scores": ngram_lm.oracle_sql(), "op11_divergence": divergence.oracle_sql(), "op12_clustering": clustering.oracle_sql(), "op13_exact": exact.oracle_sql()}
