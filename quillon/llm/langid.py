"""Language ID by language-bitmask n-gram filters.

Training counts letter n-grams for each language on a bounded, hashed sample of
labelled rows and enters an n-gram for a language where its rate is a fair share
of the highest rate. The filters of all languages share one table of slots with
a bit for each language (a bit-sliced Bloom filter): the AND of an n-gram's
slots is the set of languages that contain it. A text's popcounts by language,
corrected for each language's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import map_texts, slices

UNDETERMINED = "und"
#: Labelled rows that training reads for each language, about (a hashed share of the language's rows).
SAMPLE_ROWS = 2_000
#: Letters of an n-gram, slots of the filter, hash positions of an n-gram.
N, SLOTS, PROBES = 3, 1 << 18, 3
#: An n-gram is entered for a language if seen so often there and at this share of its highest rate.
LEAST_COUNT, FAIR_SHARE = 5, 0.35

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, the text of each, and whether each text has a letter.

    Lower case; everything but letters is one boundary mark. An n-gram spans
    letters and at most a mark at either end.
    """
    lowered = ["\0" + t.lower() + "\0" if t else "\0" for t in texts]
    flat = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _is_letter()[flat]
    some = np.zeros(len(texts), bool)
    some[owner[letter]] = True
    c = np.where(letter, flat, 0).astype(np.uint64)
    if len(c) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), some
    middle = np.flatnonzero(letter[1:-1]) + 1  # marks at the ends of texts keep n-grams within one text
    packed = (c[middle - 1] << np.uint64(42)) | (c[middle] << np.uint64(21)) | c[middle + 1]
    return packed, owner[middle], some


def _slots(packed: np.ndarray) -> Iterator[np.ndarray]:
    h = packed * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) & np.uint64(SLOTS - 1)


@dataclass
class LanguageFilters:
    """languages: sorted values; table: for each slot and 64 languages a mask; false_rate: by language."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: corrected n-gram counts of each language, n-grams in all, whether it has a letter."""
        packed, owner, some = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        slots = list(_slots(packed))
        for w in range(self.table.shape[1]):
            masks = self.table[slots[0], w]
            for s in slots[1:]:
                masks &= self.table[s, w]
            for bit in range(min(64, len(self.languages) - 64 * w)):
                has = (masks >> np.uint64(bit)) & np.uint64(1)
                hits[:, 64 * w + bit] = np.bincount(owner, weights=has, minlength=len(texts))
        fixed = (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)
        return np.clip(fixed, 0, None), total, some

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the best language's share of the n-grams; `und`, 0 without a letter."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        counts, total, some = self.counts(texts)
        best = counts.argmax(1)
        score = np.clip(counts[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).tolist()


def held_out(key: Column) -> Column:
    """Whether crc32(key as text) mod 5 is 0; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters from rows with a label; about `sample_rows` whole texts of each language are read, chosen by a hash of the key.

    What reaches the driver is bounded by the sample. No labelled row: no language.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageFilters([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    rate = F.create_map(*[x for v in langs for x in (F.lit(v), F.lit(min(1.0, sample_rows / sizes[v])))])
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.where(draw < rate[F.col("l")]).select("t", "l")
    schema = pa.schema([("l", pa.string()), ("g", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for v in sorted(set(own[a:b])):
                    packed, _, _ = grams([t for t, o in zip(texts[a:b], own[a:b], strict=True) if o == v])
                    g, n = np.unique(packed, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], schema=schema)

    counted = picked.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).toPandas()
    code = {v: i for i, v in enumerate(langs)}
    uniq, at = np.unique(counted["g"].to_numpy(np.int64), return_inverse=True)
    seen = np.zeros((len(uniq), len(langs)))
    seen[at, counted["l"].map(code).to_numpy(np.int64)] = counted["n"].to_numpy(float)
    rates = seen / np.maximum(seen.sum(0), 1)
    member = (rates > 0) & (rates >= FAIR_SHARE * rates.max(1, keepdims=True, initial=0))
    table = np.zeros((SLOTS, (len(langs) + 63) // 64), np.uint64)
    for i in range(len(langs)):
        for s in _slots(uniq[member[:, i]].view(np.uint64)):
            table[s, i // 64] |= np.uint64(1 << (i % 64))
    fill = [float(((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
    return LanguageFilters(langs, table, np.array(fill) ** PROBES)


def identify(df: DataFrame, filters: LanguageFilters, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, lang_pred, score of every row; null or empty text or no letter: `und`, 0.0. `keep` names columns to carry along.

    Null keys and repeated rows give a row each, an empty table none; other
    columns, whatever their names, are not read. A very long text is read in one
    piece, some 50 bytes a character.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)  # bounded: SLOTS words for each 64 languages
    return map_texts(df, [key, *(keep or [])], text, lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double")
