"""Document fingerprints: bottom-k sketches of shingle hashes, as plain columns.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's word shingles. Sketches merge by union, and estimate distinct shingles,
resemblance and containment. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed

#: Hashes kept, words of a shingle.
K, WIDTH = 64, 5
_SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def of_words(words: str, k: int = K, width: int = WIDTH) -> Column:
    """Sketch of the shingles of a column of word hashes; fewer words than `width` are one shingle, none are an empty sketch."""
    w = F.col(words)
    n = F.size(w)
    at = lambda i, j: F.get(w, i + F.lit(j))
    shingles = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[at(i, j) for j in range(width)]))
    few = F.transform(F.slice(w, 1, F.least(n, F.lit(1))), lambda _: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= width, shingles).otherwise(few))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all, 0 to 1; two empty sketches are alike."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact below k."""
    span = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained."""
    inter = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def written(s: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.concat_ws("", F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def sketches(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """docs with `sketch`. A null text counts as empty."""
    return docs.withColumn("__words", word_hashes(F.coalesce(F.col(text), F.lit("")))).withColumn("sketch", of_words("__words", k, width)).drop("__words")


def merged(docs: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each group of `by`, from rows with `sketch`: the k smallest distinct hashes by rank, pre-aggregated by hash."""
    hashes = docs.select(*by, F.explode("sketch").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    return hashes.withColumn("n", rank).where(F.col("n") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): for each distinct key the next smaller one; the largest after the smallest.

    Keys are range-partitioned and looked up within partitions; only each
    partition's largest key crosses over (a row for each partition).
    """
    parts = ids.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id())
    parts = checkpointed(parts)
    ends = parts.groupBy("part").agg(F.max(key).alias("top"))
    over = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("top").over(over).alias("below"), F.max("top").over(Window.partitionBy(F.lit(0))).alias("last"))
    own = F.lag(key).over(Window.partitionBy("part").orderBy(key))
    return parts.withColumn("own", own).join(ends, "part").select(key, F.coalesce("own", "below", "last").alias("next"))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """key, n_chars, edited, sketch, edited_sketch, near_edited, near_next of every row.

    edited: the last floor(n_chars / 3) code points replaced by the first as
    many of the next document's (in descending key order, the first after the
    last). Null text counts as empty. Repeated rows give a row each, an empty table
    none; other columns, whatever their names, are not read. Of rows that share a key, the one with
    the smallest text is the others' next document. A null key has no next
    document: its text is not edited and near_next is null.
    """
    plain = sketches(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", k, width)
    base = plain.where(F.col(key).isNotNull()).repartition(key)  # one exchange of the texts serves both sides of the join
    sized = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n"))
    need = next_ids(docs, key).join(sized, key).select(F.col("next"), F.col(key).alias("to"), F.expr("n div 3").cast("int").alias("cut"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("text"))
    heads = base.withColumn("__n", first).where("__n = 1").join(need, F.col(key) == F.col("next"))
    heads = heads.select("to", F.expr("substring(text, 1, cut)").alias("head"), F.col("sketch").alias("next_sketch"))
    n = F.length("text")
    cut = F.expr("cast(length(text) div 3 as int)")
    alone = plain.where(F.col(key).isNull()).withColumns({c: F.lit(None).cast(heads.schema[c].dataType) for c in heads.columns})
    both = base.join(heads, F.col(key) == F.col("to"), "left").unionByName(alone)
    edited = both.select(
        key,
        n.cast("long").alias("n_chars"),
        "sketch",
        "next_sketch",
        F.when(F.col("to").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))).alias("edited"),
    )
    edited = edited.withColumn("__words", word_hashes(F.col("edited"))).withColumn("edited_sketch", of_words("__words", k, width)).drop("__words")
    return edited.select(
        key, "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next")
    )
