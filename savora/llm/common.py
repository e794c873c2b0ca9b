"""Small pieces that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The white space of all word counts here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD_SQL = "[^ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null has none. Plain splitting on one character, no regular expression."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def map_batches(df: DataFrame, columns: Sequence[str], fn: Callable[[list[list]], Iterator[dict] | dict], schema: str) -> DataFrame:
    """Run `fn` on Arrow batches of the named columns, given as Python lists; it returns a dict of
    columns, or yields several. Only the named columns leave the scan."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            made = fn([batch.column(i).to_pylist() for i in range(batch.num_columns)])
            for part in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_pydict(part, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def slices(n: int, sizes: Sequence[int], limit: int) -> Iterator[range]:
    """Consecutive index ranges over n items whose sizes add up to about `limit` at most."""
    start = total = 0
    for i in range(n):
        if total and total + sizes[i] > limit:
            yield range(start, i)
            start, total = i, 0
        total += sizes[i]
    if start < n:
        yield range(start, n)
