"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.session import checkpointed

#: ASCII white space and its replacement pattern (fixed by the contracts).
ASCII_SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["ASCII_SPACE", "ascii_lower", "checkpointed", "crc_remainder", "is_empty", "pick_columns", "pieces", "table"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo `modulus`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows: what a task holds beside a batch, texts and hashes as Python has them, is that of a part only."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pick_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that a caller's further columns can't clash with working ones."""
    return df.select(*[df[n] for n in names])
