"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenmart import session
from lumenmart.session import spread, stage, work_folder

__all__ = ["WORD", "BLANK", "fold", "lean", "plain", "row_key", "scratch", "small_slices", "spread", "stage", "table", "tune", "whole_row"]

#: Words and the blanks between them: the ASCII white space of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder; it goes with the staged tables."""
    return work_folder(spark, name)


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text only, null texts as empty; other columns cannot clash with added ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct column `row`, whatever their names."""
    return F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in docs.columns]).alias("row")


def row_key() -> list[Column]:
    """Identity of a document row: its id and a hash of its text. Rows equal in both get equal results."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def fold(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equality join that keeps one copy of the keys (left's)."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


#: What Spark hands to Python at once; texts may be long.
ARROW_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def lean(run: Callable) -> Callable:
    """The same batch function; when it ends, its worker gives freed memory back, as workers outlive their tasks."""

    def outer(parts):
        yield from run(parts)
        release()

    return outer


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tune(spark: SparkSession) -> SparkSession:
    """The session's runtime settings and small Arrow batches."""
    for key, value in ARROW_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return session.tune(spark)


def small_slices(part: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of a text column each, or one longer row."""
    lengths = pa.compute.binary_length(part.column(part.schema.get_field_index(column))).fill_null(0).to_pylist()
    begin = held = 0
    for at, length in enumerate(lengths):
        if held and held + length > size:
            yield part.slice(begin, at - begin)
            begin, held = at, 0
        held += length
    if begin < part.num_rows:
        yield part.slice(begin)
