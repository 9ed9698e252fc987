"""A corpus pipeline of five stages over `documents`, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; a stage's
rows are written as Parquet and read again as the next one's docs.

In every stage null keys and repeated rows are rows of their own unless it says
otherwise, an empty table gives none, and columns other than those of
`documents`, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, mixing, pii, simhash
from quillon.llm.queries import tokenizer_path
from quillon.session import new_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a document's letter n-grams that its language must have.
LEAST_LANGUAGE = 0.2
#: Mixing: tokens asked for as a share of all, and uses of a document at most.
MIX_SHARE, MIX_EPOCHS = 1.0, 2
#: What a worker of the last stage keeps for reuse, after what four stages have left in it.
ENCODE_ROOM = 2_500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; `lang` is the language found. Null texts and texts without a letter go."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.train(docs), keep=["text", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies; texts without a word are alike, null keys stay."""
    return simhash.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text, null for a null text."""
    found = pii.detect(docs.select(*COLUMNS), keep=["lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture uses them, each for itself; of the one at which a leaf's prefix ends the last use is its first words, n_chars that of the cut text. Null, empty and blank texts have no word to use."""
    docs = docs.select(*COLUMNS)
    used = mixing.mix(docs, budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS, keep=COLUMNS)
    cut = F.when(F.col("partial_tokens") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    again = used.select("row.*", "partial_tokens", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("copies").cast("int")), cut)).alias("__cut"))
    again = again.withColumn("text", F.when(F.col("__cut"), mixing.first_words("text", "partial_tokens")).otherwise(F.col("text")))
    return again.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each document; null and empty texts have none."""
    found = bpe.encode_decode(docs.select(*COLUMNS), tokenizer_path(), keep=["lang", "source"], room=ENCODE_ROOM)
    return found.select("doc_id", "lang", "source", "n_tokens", bpe.ids().alias("ids"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL has no SimHash, no language filters and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared checkpoint folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
