"""Arrow batch plumbing for per-document operators: whole texts in, columns out, bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters of text that one call of a batch function gets, unless a single text is longer.
BATCH_CHARS = 400_000


def slices(texts: list, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold at most `most` characters together, one text at least."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keys: list[str], text: str, fn: Callable[[list], list[list]], schema: str, most: int = BATCH_CHARS) -> DataFrame:
    """Columns `keys` of every row with the columns that `fn` makes of its text.

    fn gets a list of texts (None for null) and returns one list of values for
    each column of `schema`. Narrow: no shuffle, one task per input split.
    """
    spark_schema = StructType([df.schema[k] for k in keys] + list(_parse_datatype_string(schema)))
    arrow = to_arrow_schema(spark_schema)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i).cast(arrow.field(i).type) for i in range(n_keys)]
            texts = batch.column(n_keys).to_pylist()
            for a, b in slices(texts, most):
                made = fn(texts[a:b])
                out = [c.slice(a, b - a) for c in own]
                out += [pa.array(v, arrow.field(n_keys + j).type) for j, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return df.select(*keys, df[text].alias("__text")).mapInArrow(run, spark_schema)
