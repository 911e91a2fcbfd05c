"""Reading panels and writing results."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.cells import NULL_TOKENS


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the usual tokens of missing values as null.

    Types are inferred later and from training rows only: a bad cell in a held-out row cannot change them, and declared
    categories keep texts like 01.
    """
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False, inferSchema=False)
    return frame.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in frame.columns])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel by the path's ending: CSV, Parquet, ORC or JSON lines; anything else is read as Parquet."""
    ending = Path(path).suffix.lower()
    if ending == ".csv":
        return read_panel_csv(spark, path)
    return {".orc": spark.read.orc, ".json": spark.read.json, ".jsonl": spark.read.json}.get(ending, spark.read.parquet)(path)


def strict_json(value: object, **options) -> str:
    """JSON without NaN or infinity."""
    return json.dumps(value, allow_nan=False, **options)


def write_json(value: object, path: str | Path) -> None:
    Path(path).write_text(strict_json(value, indent=2) + "\n", encoding="utf-8")


class JsonLines:
    """A checkpointed sink: each record is on disk before the next one begins; an existing file is not overwritten."""

    def __init__(self, path: str | Path):
        self._file = open(path, "x", encoding="utf-8")

    def write(self, record: dict) -> None:
        self._file.write(strict_json(record) + "\n")
        self._file.flush()
        os.fsync(self._file.fileno())

    def __enter__(self) -> JsonLines:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


def write_table(frame: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet that must not exist yet."""
    frame.write.mode("error").partitionBy(*partition_by).parquet(path)
