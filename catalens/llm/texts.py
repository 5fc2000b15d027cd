"""What the text operators share: reading documents, folds, and running Python over record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a Python step holds at once; texts are long, so fewer than Spark's default.
STEP_ROWS = 2_000


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else ``docs`` carries; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(modulus: int) -> Column:
    """crc32 of the id's decimal digits modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def by_rows(
    df: DataFrame, of_rows: Callable[[list, list], dict[str, list]], schema: str, start: Callable | None = None
) -> DataFrame:
    """Run ``of_rows(ids, texts)`` over slices of every partition; it returns the output columns of that slice.

    ``df`` has doc_id and text as its first two columns. ``start()``, if given, makes the function once for each task, so
    that models and memos are set up on the executor.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start() if start else of_rows
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                out = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({k: pa.array(out[k], arrow_types[k]) for k in names})

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    arrow_types = {part.split()[0]: types[part.split()[1]] for part in schema.split(",")}
    return df.mapInArrow(run, schema)
