"""Panel checks and outcome leads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.cells import canonical_time, number
from panelloom.plans.spec import StudySpec

LEAD_TIME = "__lead_time"


@dataclass(frozen=True)
class PanelSummary:
    row_count: int
    entity_count: int
    observed_columns: tuple[str, ...]
    duplicate_entity_times: int
    warnings: tuple[str, ...]


@dataclass(frozen=True)
class Lagged:
    """The panel with leads. targets and eligible: outcome -> column."""

    frame: DataFrame
    id_column: str
    time_column: str
    lag: int
    targets: dict[str, str] = field(default_factory=dict)
    eligible: dict[str, str] = field(default_factory=dict)


def summary_frame(frame: DataFrame, id_column: str, time_column: str) -> DataFrame:
    """One row: rows, exact entities, extra rows per (entity, time), and missing keys."""
    i, t = F.col(f"`{id_column}`"), F.col(f"`{time_column}`")
    keys = frame.groupBy(i.alias("i"), t.alias("t")).agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.countDistinct("i").alias("entity_count"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicate_entity_times"),
        F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("missing_times"),
    )


def validate_panel(frame: DataFrame, spec: StudySpec) -> PanelSummary:
    """Check required columns and keys; duplicates and a single entity are warnings."""
    needed = [spec.id_column, spec.time_column, *spec.outcomes, *spec.interventions]
    missing = sorted({c for c in needed if c not in frame.columns})
    if missing:
        raise ValueError(f"the panel has no columns {missing}")
    row = summary_frame(frame, spec.id_column, spec.time_column).first()
    if row["missing_ids"]:
        raise ValueError(f"{row['missing_ids']} rows have no {spec.id_column!r}")
    if row["missing_times"]:
        raise ValueError(f"{row['missing_times']} rows have no {spec.time_column!r}")
    warnings = []
    if row["duplicate_entity_times"]:
        warnings.append(f"{row['duplicate_entity_times']} rows repeat an entity and time; leads follow the tie columns there")
    if row["entity_count"] < 2:
        warnings.append("there is one entity only: splits by entity are impossible")
    return PanelSummary(row["row_count"], row["entity_count"], tuple(frame.columns), row["duplicate_entity_times"], tuple(warnings))


def build_lagged(frame: DataFrame, spec: StudySpec, outcomes: list[str] | None = None, lag: int = 1, tie: tuple[str, ...] = ()) -> Lagged:
    """Each row with the outcomes and the time `lag` rows later in its entity; rows without a later row go.

    A row whose later outcome is missing stays: eligibility is a column of its own, so that targets never change who is
    in the panel. tie: columns that order rows of one entity and time.
    """
    if lag < 1:
        raise ValueError("lag must be 1 or more")
    chosen = list(outcomes or spec.outcome_columns(frame.columns))
    if not chosen:
        raise ValueError("there is no outcome column")
    if absent := [c for c in chosen if c not in frame.columns]:
        raise ValueError(f"the panel has no outcome columns {absent}")
    targets = {c: f"{c}__lead{lag}" for c in chosen}
    eligible = {c: f"__target_eligible__{c}" for c in chosen}
    made = {LEAD_TIME, *targets.values(), *eligible.values()}
    if clash := sorted(c for c in frame.columns if c in made or c.startswith("__panel_")):
        raise ValueError(f"columns {clash} have names that leads need")
    order = Window.partitionBy(f"`{spec.id_column}`").orderBy("__panel_t", *[f"`{c}`" for c in tie])
    out = frame.withColumn("__panel_t", canonical_time(frame, spec.time_column))
    later = {name: F.lead(f"`{c}`", lag).over(order) for c, name in targets.items()}
    out = out.withColumns({**later, LEAD_TIME: F.lead("__panel_t", lag).over(order)}).where(F.col(LEAD_TIME).isNotNull())
    checks = {eligible[c]: number(targets[c], frame.schema[c].dataType).isNotNull() for c in chosen}
    return Lagged(out.withColumns(checks), spec.id_column, spec.time_column, lag, targets, eligible)


def join_labels(frame: DataFrame, labels: DataFrame, spec: StudySpec, name: str) -> DataFrame:
    """The frame with a column of labels found by entity and time, whatever rows and order either side has.

    Rows without a label, and an entity and time with two of them, are errors.
    """
    if name in frame.columns:
        raise ValueError(f"the frame already has a column {name!r}")
    keys = [spec.id_column, spec.time_column]
    side = labels.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__labels"), F.first(f"`{name}`").alias(name))
    out = frame.join(side, keys, "left")
    bad = out.agg(F.count_if(F.col(f"`{name}`").isNull()).alias("absent"), F.count_if(F.col("__labels") > 1).alias("twice")).first()
    if bad.absent or bad.twice:
        raise ValueError(f"{bad.absent} rows have no label, {bad.twice} have more than one")
    return out.drop("__labels")
