"""Stupid-backoff scores: n-gram count tables joined to the n-grams of documents.

Counts are over the words of all documents; n-grams of two or more words that
occur fewer than `least` times are not in the tables. A word scores its count
among what followed the longest context found, times ALPHA for each order
backed off; the last resort is its share of all words. Scores of a document are
summed as log10. Words, contexts and n-grams are 64-bit hashes; tables are
partitioned by hash and joined by the request and reply of packed.py.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import packed

ALPHA, ORDER, LEAST = 0.4, 2, 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ALL = np.uint64(0x5851F42D4C957F2D)  # stands for the empty n-gram, whose count is that of all words
#: Characters that are taken apart at a time within a block.
STEP_CHARS = 1_000_000


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for n of 1 to `order` (0 where the text has too few words before), and the text of each word."""
    digest = xxhash.xxh64_intdigest
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.fromiter((digest(w) for ws in words for w in ws), np.uint64, total)
    out = [first]
    for n in range(2, order + 1):
        h = np.zeros(total, np.uint64)
        if total >= n:
            whole = owner[n - 1 :] == owner[: total - n + 1]
            h[n - 1 :] = np.where(whole, _mix(out[-1][: total - 1][n - 2 :], first[n - 1 :]), np.uint64(0))
        out.append(h)
    return out, owner


def _steps(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > STEP_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _counted(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the n-grams of up to `order` words and of the empty one, and how often each occurs."""
    parts, counts = [], []
    for a, b in _steps(texts):
        hashes, owner = grams(texts[a:b], order)
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        parts += [h, np.array([_ALL])]
        counts += [n, np.array([len(owner)])]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    real = (h != 0) & (n > 0)
    return h[real], n[real]


def _scored(texts: list[str], order: int, least: int, asked: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """(words, words that backed off, log10 score) of each text."""

    def count(h: np.ndarray) -> np.ndarray:
        return np.where(h == 0, 0, total[np.minimum(np.searchsorted(asked, h), len(asked) - 1)]).astype(float)

    out = []
    for a, b in _steps(texts):
        hashes, owner = grams(texts[a:b], order)
        counts = [count(h) for h in hashes]
        everything = float(count(np.array([_ALL]))[0]) if len(owner) else 1.0
        value = np.zeros(len(owner))
        done = np.zeros(len(owner), bool)
        reach = np.minimum(order, 1 + np.arange(len(owner)) - np.searchsorted(owner, owner))  # longest n-gram that fits in the text
        backed = np.zeros(len(owner), bool)
        for n in range(order, 1, -1):
            c = counts[n - 1]
            use = ~done & (reach >= n) & (c >= least)
            context = np.concatenate(([1.0], counts[n - 2][:-1]))
            value[use] = np.log10(c[use] / context[use]) + (reach[use] - n) * np.log10(ALPHA)
            backed |= use & (reach > n)
            done |= use
        rest = ~done
        value[rest] = np.log10(counts[0][rest] / everything) + (reach[rest] - 1) * np.log10(ALPHA)
        backed |= rest & (reach > 1)
        m = b - a
        out += list(zip(np.bincount(owner, minlength=m).tolist(), np.bincount(owner, weights=backed, minlength=m).astype(int).tolist(), np.bincount(owner, weights=value, minlength=m).tolist(), strict=True))
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST) -> DataFrame:
    """key, n_words, n_backoff, log10_score (sum) and per_word of every row.

    Null and texts without a word have 0 words, score 0 and a null per_word.
    Repeated rows count, and score, each for itself; null keys too. An empty
    table gives no row; columns other than key and text, whatever their names,
    are not read. A very long text is one block's, taken apart step by step.
    """
    plan = packed.size_up(docs, text, hashes_per_char=0.16 * order)
    # keys travel as text: pandas would turn whole numbers beside a null into floats
    blocks = packed.in_blocks(docs.select(F.col(key).cast("string"), text), key, text, plan)
    replies = packed.totals(packed.requests(blocks, plan, lambda texts: _counted(texts, order), counted=np.uint64), np.uint64, counted=np.uint64, blocks=plan.blocks)
    kind = docs.schema[key].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = left["text"].tolist()
        asked, _ = _counted(texts, order)
        rows = pd.DataFrame(_scored(texts, order, least, asked, packed.aligned(right, np.uint64)), columns=["n_words", "n_backoff", "log10_score"])
        rows.insert(0, key, left[key].to_numpy())
        rows["per_word"] = [s / n if n else None for s, n in zip(rows["log10_score"], rows["n_words"], strict=True)]
        return rows

    schema = f"`{key}` string, n_words long, n_backoff long, log10_score double, per_word double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema).withColumn(key, F.col(key).cast(kind))


def oracle_sql(order: int = ORDER, least: int = LEAST) -> str:
    """The same in DuckDB's SQL over `documents`, scores rounded to 6 places. p1 is the word before, p2 the one before that."""
    before = [f"p{k}" for k in range(1, order)]
    names = lambda n: [*before[: n - 1][::-1], "w"]
    tables = [f"c{n} AS (SELECT {', '.join(names(n))}, count(*) AS c FROM g {f'WHERE p{n - 1} IS NOT NULL ' if n > 1 else ''}GROUP BY ALL{f' HAVING count(*) >= {least}' if n > 1 else ''})" for n in range(1, order + 1)]
    joins, cases = [], []
    for n in range(order, 0, -1):
        joins.append(f"LEFT JOIN c{n} ON {' AND '.join(f'c{n}.{x} = g.{x}' for x in names(n))}")
        if n > 1:  # the context of the n-gram is the (n - 1)-gram of the words before
            joins.append(f"LEFT JOIN c{n - 1} x{n} ON {' AND '.join(f'x{n}.{a} = g.{b}' for a, b in zip(names(n - 1), names(n)[:-1], strict=True))}")
            cases.append(f"WHEN c{n}.c IS NOT NULL THEN log10(c{n}.c::DOUBLE / x{n}.c) + (reach - {n}) * log10({ALPHA})")
    used = " ".join(f"WHEN c{n}.c IS NOT NULL THEN {n}" for n in range(order, 1, -1))
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, w, least(i, {order}) AS reach{''.join(f', lag(w, {k}) OVER (PARTITION BY r ORDER BY i) AS p{k}' for k in range(1, order))} FROM t),
{', '.join(tables)},
s AS (SELECT g.r, CASE WHEN FALSE THEN 1 {used} ELSE 1 END < reach AS backed, CASE WHEN FALSE THEN 0.0 {' '.join(cases)} ELSE log10(c1.c::DOUBLE / (SELECT count(*) FROM t)) + (reach - 1) * log10({ALPHA}) END AS v FROM g {' '.join(joins)}),
d AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE backed) AS n_backoff, sum(v) AS v FROM s GROUP BY r)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(v, 0), 6) AS log10_score, round(v / n_words, 6) AS per_word
FROM w LEFT JOIN d USING (r)"""
