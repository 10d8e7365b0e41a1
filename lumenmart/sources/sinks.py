"""Table writes: full replacement, appends and user files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def save_listings(listings: DataFrame, path: str) -> None:
    """Replace the live listing table, laid out by segment for pruning."""
    listings.write.mode("overwrite").partitionBy("segment").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append runs, errors or health rows."""
    rows.write.mode("append").parquet(path)


def user_rows(frame: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Columns as file text: arrays as JSON, null as empty, booleans in lower case."""
    kinds = dict(frame.dtypes)
    text = lambda name: F.to_json(F.col(name)) if kinds[name].startswith("array") else F.col(name).cast("string")
    return frame.select(*[F.coalesce(text(name), F.lit("")).alias(name) for name in fields])


def save_user_table(frame: DataFrame, fields: Sequence[str], path: str) -> None:
    user_rows(frame, fields).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
