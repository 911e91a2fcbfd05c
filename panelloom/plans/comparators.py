"""What a chosen recipe is compared with on the holdout: other models of the same rows, all fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import number
from panelloom.operators.encoders import Encoder
from panelloom.operators.models import fit_linear_model, polynomial_terms, treatment_effects
from panelloom.operators.panel import build_lagged, join_labels
from panelloom.operators.splits import OUTER, plan_splits
from panelloom.plans.spec import StudySpec

STATE, LABEL = "__state", "prespecified"
#: Names of the compared models.
COMPARATORS = ("selected_macro", "restricted_micro", "no_macro", "prespecified_macro", "flexible_micro", "matched_micro")
#: The most states that become indicator columns.
MOST_STATES = 64


@dataclass(frozen=True)
class Sides:
    """Training and test rows of a discovery's outer split, with the state of its chosen recipe."""

    train: DataFrame
    test: DataFrame
    target: str

    def both(self, change) -> Sides:
        return Sides(change(self.train), change(self.test), self.target)

    def r2(self, features: list[str]) -> float:
        return fit_linear_model(self.train, features, self.target).r2(self.test)


def outer_sides(frame: DataFrame, spec: StudySpec, document: dict, scratch, labels: DataFrame | None = None) -> Sides:
    """Plan the document's split again, find each row's state and, by entity and time, its label; rows are saved once."""
    config = document["config"]
    lagged = build_lagged(frame, spec, [config["outcome"]], config["lag"])
    rows = lagged.frame if labels is None else join_labels(lagged.frame, labels, spec, LABEL).withColumn(LABEL, F.col(LABEL).cast("string"))
    plan = plan_splits(rows, spec.id_column, config["validation_mode"], config["folds"], config["holdout_fraction"], config["seed"], config["split_hash"])
    encoder = Encoder.from_dict(document["outer_evaluation"]["encoder"])
    types = {f.name: f.dataType for f in plan.frame.schema.fields}
    state = encoder.column([number(c, types[c]) for c in encoder.recipe.columns]).cast("string")
    saved = scratch.save(lambda: plan.frame.where(F.col(OUTER).isNotNull()).withColumn(STATE, state), "sides")
    return Sides(saved.where(F.col(OUTER) == "train"), saved.where(F.col(OUTER) == "test"), lagged.targets[config["outcome"]])


def compare(sides: Sides, document: dict) -> dict[str, float | None]:
    """Held-out R2 of the chosen states, raw columns, an intercept, declared states, squares and products, and indicators of the states.

    Categories that only test rows have count as the training reference. `prespecified_macro` is None without labels.
    """
    treatments = document["columns"]["interventions"]
    raw = list(dict.fromkeys([*treatments, *document["columns"]["micro_features"]]))
    numeric = [c for c in raw if document["feature_schema"][c]["kind"] == "numeric"]
    squared = sides.both(lambda side: polynomial_terms(side, numeric, fitted_on=sides.train)) if numeric else sides
    states = sorted(r[0] for r in sides.train.select(STATE).distinct().limit(MOST_STATES + 1).collect())
    if len(states) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    flags = {f"__is_{k}": (F.col(STATE) == s).cast("double") for k, s in enumerate(states[1:])}
    matched = sides.both(lambda side: side.withColumns(flags)) if flags else sides
    return {
        "selected_macro": sides.r2([*treatments, STATE]),
        "restricted_micro": sides.r2(raw),
        "no_macro": sides.r2([]),
        "prespecified_macro": sides.r2([*treatments, LABEL]) if LABEL in sides.train.columns else None,
        "flexible_micro": squared.r2([*raw, *(c for c in squared.train.columns if c.startswith("poly_"))]),
        "matched_micro": matched.r2([*treatments, *flags]),
    }


def state_support(sides: Sides, id_column: str, by: str = STATE) -> list[dict]:
    """Rows and entities of each state on both sides."""
    named = sides.train.select(by, id_column, F.lit("train").alias("s")).unionByName(sides.test.select(by, id_column, F.lit("test").alias("s")))
    cells = [x for s in ("train", "test") for x in (F.count_if(F.col("s") == s).alias(f"{s}_rows"), F.countDistinct(F.when(F.col("s") == s, F.col(id_column))).alias(f"{s}_entities"))]
    return [{"state": r[by]} | {c: r[c] for c in r.asDict() if c != by} for r in named.groupBy(by).agg(*cells).orderBy(by).collect()]


def confounding_coefficients(train: DataFrame, target: str, treatments: list[str], confounder: str, state: str = STATE) -> dict[str, dict[str, float | None]]:
    """Coefficients of the treatments alone, each by itself; jointly with the confounder; and jointly with the states in its place."""

    def joint(adjustments: list[str]) -> dict[str, float | None]:
        return {r["intervention"]: r["coefficient"] for r in treatment_effects(train, treatments, target, adjustments)}

    alone = {t: treatment_effects(train, [t], target, [])[0]["coefficient"] for t in treatments}
    return {"marginal": alone, "joint_raw_confounder": joint([confounder]), "coarse_macro_adjusted": joint([state])}
