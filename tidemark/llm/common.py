"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut  # noqa: F401  (re-exported: the operators' cut point)

#: What separates words: the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; bytes.split and bytes.lower do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def renamed(df: DataFrame, taken: Iterable[str]) -> DataFrame:
    """``df`` without the columns whose names an operator needs for its own results."""
    clash = {c.lower() for c in taken}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def batches(it: Iterator[pa.RecordBatch], schema: pa.Schema, rows: Iterator[tuple], size: int = 2048):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
