"""Frozen encoders on streams.

An applied encoder is a stateless expression, so a stream needs no state for it; windowed counts per state use a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import number
from panelloom.operators.encoders import Encoder


def with_state(frame: DataFrame, encoder: Encoder, name: str = "state") -> DataFrame:
    """Adds the macro state of each row; for batch and streaming frames."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    return frame.withColumn(name, encoder.column([number(c, types[c]) for c in encoder.recipe.columns]))


def state_counts(frame: DataFrame, encoder: Encoder, time_column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per event-time window and state; rows later than `late` are not counted."""
    return with_state(frame, encoder).withWatermark(time_column, late).groupBy(F.window(time_column, window), "state").agg(F.count("*").alias("n"))
