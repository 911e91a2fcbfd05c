"""Cells of open-ended tables as typed Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cell texts of CSV files that stand for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: What text counts as a number: no type suffixes and no digit separators, which Spark's or other engines' casts accept.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def number(name: str, kind: T.DataType) -> Column:
    """The column as a finite double, else null."""
    cell = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return cell.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        value = cell.cast("double")
    else:
        text = cell.cast("string")
        value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def is_numeric_text(name: str, kind: T.DataType) -> Column:
    """Whether a non-null cell can be read as a number (infinity included, booleans not)."""
    cell = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return ~F.isnan(cell.cast("double"))
    text = cell.cast("string")
    return text.rlike(NUMBER) | text.rlike(INFINITY)


def present(name: str, kind: T.DataType) -> Column:
    """Whether the cell has a value: NaN counts as missing."""
    cell = F.col(f"`{name}`")
    return cell.isNotNull() & ~F.isnan(cell) if isinstance(kind, (T.DoubleType, T.FloatType)) else cell.isNotNull()


def category(name: str, kind: T.DataType) -> Column:
    """The cell as text; missing stays null."""
    return F.when(present(name, kind), F.col(f"`{name}`").cast("string"))


def canonical_time(frame: DataFrame, name: str) -> Column:
    """An ordered column for a time: dates and timestamps as they are, numbers as numbers, texts as numbers if all are, else
    as timestamps; anything else is an error."""
    kind, cell = frame.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)):
        return cell
    if not isinstance(kind, T.StringType):
        raise ValueError(f"time column {name!r} of type {kind.simpleString()} has no order in time")
    row = frame.agg(
        F.count(cell).alias("n"),
        F.count_if(cell.rlike(NUMBER)).alias("numbers"),
        F.count_if(cell.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias("integers"),
        F.count(cell.try_cast("timestamp")).alias("stamps"),
    ).first()
    if row["integers"] == row["n"]:
        return F.trim(cell).try_cast("long")
    if row["numbers"] == row["n"]:
        return F.trim(cell).try_cast("double")
    if row["stamps"] == row["n"]:
        return cell.try_cast("timestamp")
    raise ValueError(f"time column {name!r} holds values that are neither numbers nor dates")
