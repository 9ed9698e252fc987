"""Source divergence audit: which sources of a language differ in the words they use, and by which words.

Plain relational work: terms of all texts are exploded and counted by language,
source and term; a language keeps the terms that enough of its documents have;
its sources are crossed with these terms, so that a term that a source lacks has
a row with a count of zero; the dense table joined to itself on language and
term gives the distance of each two sources; windows rank.

Frequencies are whole numbers, parts of 10^9 with `SMOOTH` added to each count,
so all sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import materialised

LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
#: The same characters named one by one: Java's patterns are ten times as fast on these as on a class that is negated.
LETTER_JAVA = r"[A-Za-z\x80-\x{10FFFF}]"
#: Documents of its language that a kept term occurs in, at least; what is added to each count; the whole; ranks of terms.
LEAST_DOCS, SMOOTH, WHOLE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Characters of a text that are taken apart at a time.
PIECE = 1 << 20
#: Parts that a language's kept terms are dealt into when they meet its sources.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a lower-cased text in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(LETTER_JAVA + "+"), F.lit(0))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", piece: int = PIECE) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it).

    A document's terms are exploded behind its distinct ones, so one explode and
    one aggregate, combined in the task, count both. A text of over `piece`
    characters is cut after a term at least that far on: what is exploded at a
    time is bounded, and only its distinct terms are held for the whole text.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), low.alias("low"))
    cut = F.regexp_extract_all("low", F.lit(f"(?s).{{{piece}}}{LETTER_JAVA}*+|.+"), F.lit(0))
    part = lambda p, whole, first: F.struct(p.alias("piece"), F.lit(whole).alias("whole"), first.alias("first"))
    none = F.array().cast("array<string>")
    union = F.aggregate(cut, none, lambda acc, p: F.array_union(acc, terms(p)))
    long = F.concat(F.transform(cut, lambda p: part(p, False, none)), F.array(part(F.lit(""), False, union)))
    parts = F.when(F.length("low") > piece, long).otherwise(F.array(part(F.col("low"), True, none)))
    pieces = rows.select("lang", "source", F.explode(parts).alias("p")).select("lang", "source", "p.*")
    taken = pieces.withColumn("terms", terms(F.col("piece")))
    led = taken.withColumn("lead", F.when(F.col("whole"), F.array_distinct("terms")).otherwise(F.col("first")))
    every = led.select("lang", "source", F.size("lead").alias("n_lead"), F.posexplode(F.concat("lead", "terms")).alias("at", "term"))
    of_doc = (F.col("at") < F.col("n_lead")).cast("long")
    return every.groupBy("lang", "source", "term").agg(F.sum(1 - of_doc).alias("n"), F.sum(of_doc).alias("docs"))


def per_whole(n: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE (n + SMOOTH) / (total + SMOOTH kept)), exact for counts of any size a long holds."""
    return F.expr(f"1 + (CAST({WHOLE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(20,0))) div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20,0))")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, piece: int = PIECE) -> DataFrame:
    """lang, source, part, item, value long, rank int.

    Part `pair`: item is each other source of the language, value the sum over
    the language's kept terms of the difference of both sources' frequencies,
    all ranks; 0 where the language keeps no term. Part `term`: item is each
    kept term that the source uses more than its language does, value by how
    much, `top_terms` ranks. Ranks are from 1, largest value first, then item.

    Null texts, languages and sources count as empty ones; an empty name is a
    language or source of its own, and documents without a term make their
    group occur. Repeated rows are documents each. An empty table gives no row;
    other columns, whatever their names, are not read.

    No key is hot: counts are combined before the shuffle, terms of a language
    meet its sources in SALTS parts, and the self-join has a row for each source
    under a key.
    """
    counts = materialised(counted(docs, text, lang, source, piece))
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = materialised(kept)
    own = materialised(counts.drop("docs").join(kept, ["lang", "term"]))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialised(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]))

    salted = kept.select("lang", "term").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = salted.join(spread, ["lang", "salt"]).join(own.drop("lang_n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", zero))
    dense = dense.select("lang", "term", "source", per_whole("n", "total", "kept").alias("p"))

    a, b = dense.alias("a"), dense.alias("b")  # alike, so they are worked out and dealt once
    col = lambda side, c: F.col(f"{side}.{c}")
    met = a.join(b, (col("a", "lang") == col("b", "lang")) & (col("a", "term") == col("b", "term")) & (col("a", "source") < col("b", "source")))
    gap = F.abs(col("a", "p") - col("b", "p"))
    sums = met.groupBy(col("a", "lang").alias("lang"), col("a", "source").alias("source"), col("b", "source").alias("other")).agg(F.sum(gap).alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")
    bare = groups.where("kept = 0").select("lang", "source")
    alike = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).withColumn("value", zero)
    pairs = pairs.unionByName(alike).withColumn("part", F.lit("pair"))
    used = own.where("n > 0").join(groups, ["lang", "source"])
    more = used.select("lang", "source", F.col("term").alias("item"), (per_whole("n", "total", "kept") - per_whole("lang_n", "lang_total", "kept")).alias("value"), F.lit("term").alias("part")).where("value > 0")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top_terms))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def oracle_sql(least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> str:
    """The same in DuckDB's SQL over `documents`."""
    p = lambda n, total, v: f"CAST(1 + (CAST({WHOLE} AS HUGEINT) * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * {v}) AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(low, '{LETTER}+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
own AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS BIGINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM own o WHERE o.lang = x.lang AND o.source = x.source) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, {p('coalesce(o.n, 0)', 'g.total', 'l.v')} AS p, {p('k.lang_n', 'l.lang_total', 'l.v')} AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top_terms}"""
