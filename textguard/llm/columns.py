"""Columns that an operator hands on unchanged, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(rows: DataFrame, *new: str) -> list[Column]:
    """All columns of ``rows`` but those that an operator writes anew (names without case)."""
    taken = {name.lower() for name in new}
    return [named(name) for name in rows.columns if name.lower() not in taken]
