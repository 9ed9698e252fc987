"""Hands as token documents: token sequences, n-grams, TF-IDF, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size_class(amount: Column, pot: Column) -> Column:
    f = amount / pot
    return F.when(F.coalesce(amount, F.lit(0.0)) <= 0, "0").when(F.coalesce(pot, F.lit(0.0)) <= 0, "m").when(f < 0.4, "s").when(f < 0.8, "m").when(f < 1.5, "l").otherwise("o")


def hero_tokens(hand: DataFrame, act: DataFrame) -> DataFrame:
    """chunk_id, hand_ix, act_ix, token: hero's actions as street, kind and size."""
    street = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s in ("preflop", "flop", "turn", "river") for x in (s, s[0])]), F.lower("street")), F.lit("?"))
    kinds = {"fold": "F", "check": "X", "call": "C", "bet": "B", "raise": "R", "all_in": "A"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    size = size_class(F.when(F.coalesce("amount", F.lit(0.0)) != 0, F.col("amount")).otherwise(F.col("raise_to")), F.col("pot_before"))
    own = act.join(hand.select("chunk_id", "hand_ix", "hero_seat"), ["chunk_id", "hand_ix"]).where(F.col("seat") == F.col("hero_seat"))
    return own.where(kind.isNotNull()).select("chunk_id", "hand_ix", "act_ix", F.concat(street, kind, size).alias("token"))


def documents(hand: DataFrame, act: DataFrame, most: int = 3) -> DataFrame:
    """chunk_id, hand_ix, doc: n-grams of hero's tokens up to `most`, position, length and number of actors, by spaces."""
    seq = hero_tokens(hand, act).groupBy("chunk_id", "hand_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("act_ix", "token"))), lambda x: x["token"]).alias("seq"))
    seats = act.groupBy("chunk_id", "hand_ix").agg(F.count_distinct(F.coalesce("seat", F.lit(-1))).alias("n_seats"))
    d = hand.join(seq, ["chunk_id", "hand_ix"], "left").join(seats, ["chunk_id", "hand_ix"], "left").withColumn("seq", F.coalesce("seq", F.array().cast("array<string>")))
    gram = lambda n: F.when(F.size("seq") >= n, F.transform(F.sequence(F.lit(1), F.size("seq") - n + 1), lambda i: F.array_join(F.slice("seq", i, n), "_"))).otherwise(F.array().cast("array<string>"))
    place = F.concat(F.lit("pos"), F.pmod(F.col("hero_seat") - F.col("button_seat"), F.greatest("max_seats", F.lit(2))).cast("string"))
    extra = F.array_compact(F.array(place, F.concat(F.lit("len"), F.least(F.size("seq"), F.lit(8)).cast("string")), F.concat(F.lit("nseats"), F.coalesce("n_seats", F.lit(0)).cast("string"))))
    return d.select("chunk_id", "hand_ix", F.array_join(F.concat(*[gram(n) for n in range(1, most + 1)], extra), " ").alias("doc"))


def tfidf(docs: DataFrame, keys: list[str], doc: str = "doc", least: int = 3) -> DataFrame:
    """keys, term, weight: counts times ln((1 + n) / (1 + df)) + 1 of terms in at least `least` documents, scaled to unit length."""
    terms = docs.select(*keys, F.explode(F.filter(F.split(F.lower(doc), r"\s+"), lambda t: t != "")).alias("term"))
    tf = terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    n = docs.agg(F.count("*").alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n), F.lit(True), "cross").withColumn("w", F.col("tf") * (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    return w.select(*keys, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).alias("weight"))


def pooled(hands: DataFrame, by: list[str], score: str, label: str, order: str) -> DataFrame:
    """Mean score of a chunk's hands, and the label of its first."""
    return hands.groupBy(*by).agg(F.avg(score).alias(score), F.min_by(label, order).alias(label))


def serve_windows(hands: DataFrame, by: list[str], ix: str, whole: int = 60, size: int = 40, least: int = 20) -> DataFrame:
    """hands with `window`: 0 for chunks of at most `whole` hands, else windows of `size`; windows of under `least` hands go."""
    n = F.count("*").over(Window.partitionBy(*by))
    w = hands.withColumn("window", F.when(n <= whole, 0).otherwise(F.floor(F.col(ix) / size)).cast("int")).withColumn("__n", n)
    own = F.count("*").over(Window.partitionBy(*by, "window"))
    return w.withColumn("__own", own).where((F.col("__n") <= whole) | (F.col("__own") >= least)).drop("__n", "__own")
