"""Linear models and single scores outside a discovery: any frame, any folds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import category, number
from panelloom.operators.adjustment import JointFactor, treatment_records
from panelloom.operators.encoders import Encoder, Recipe, replay
from panelloom.operators.factors import TEST, TRAIN, build_factors, fit_designs
from panelloom.operators.fitting import fit_recipes
from panelloom.operators.ols import Design, Fit, fit_from_factor, held_out_r2
from panelloom.operators.passes import Batch, Layout, Parts, run_pass, triangle
from panelloom.operators.scoring import COMPUTED, DECLARED, GIVEN_SPLITS, ROW_MODULO, MacroScore, PairedScores
from panelloom.operators.splits import row_modulo_folds
from panelloom.plans.spec import StudySpec

_ANY = StudySpec("", "")


@dataclass(frozen=True)
class LinearModel:
    """A frozen design encoder with its fit; it applies to any frame that has the columns."""

    target: str
    design: Design
    fit: Fit

    def prediction(self, frame: DataFrame) -> Column:
        """The prediction as an expression; unknown categories count as the reference."""
        types = {f.name: f.dataType for f in frame.schema.fields}
        out = F.lit(float(self.fit.beta[0]))
        for beta, term in zip(self.fit.beta[1:], self.design.terms(), strict=True):
            if term.kind == "numeric":
                out = out + F.lit(float(beta)) * F.coalesce(number(term.column, types[term.column]), F.lit(self.design.fills[term.column]))
            else:
                out = out + F.lit(float(beta)) * category(term.column, types[term.column]).eqNullSafe(F.lit(term.level)).cast("double")
        return out

    def r2(self, frame: DataFrame) -> float:
        """Held-out R2 about the frame's own mean; an error for fewer than two targets or a constant one."""
        rows, layout = _rows(frame, self.target, list(self.design.columns), [dict(zip(self.design.columns, self.design.kinds, strict=True))], [F.lit(TRAIN)])
        r, n, low, high = _factor(rows, layout, self.design)
        return held_out_r2(self.fit, r, n, low, high)


def _rows(frame: DataFrame, target: str, columns: list[str], kinds: list[dict[str, str]], roles: list[Column]) -> tuple[DataFrame, Layout]:
    types = {f.name: f.dataType for f in frame.schema.fields}
    numeric = [c for c in columns if any(k[c] == "numeric" for k in kinds)]
    texts = [c for c in columns if any(k[c] != "numeric" for k in kinds)]
    cells = [number(c, types[c]).alias(f"__n{j}") for j, c in enumerate(numeric)] + [category(c, types[c]).alias(f"__c{j}") for j, c in enumerate(texts)]
    y = number(target, types[target]).alias("__y")
    return frame.select(y, *[r.cast("tinyint").alias(f"__r{k}") for k, r in enumerate(roles)], *cells), Layout(len(roles), tuple(numeric), tuple(texts))


def _factor(rows: DataFrame, layout: Layout, design: Design) -> tuple[np.ndarray, int, float, float]:
    numeric, texts = ({c: j for j, c in enumerate(x)} for x in (layout.numeric, layout.categorical))

    def work(batch: Batch) -> Parts:
        at = np.isfinite(batch.y)
        if not at.any():
            return {}
        x, y = design.matrix(batch, at, numeric, texts), batch.y[at]
        return {("R",): triangle(np.column_stack([np.ones(len(y)), x, y])), ("sum",): np.array([len(y)]), ("min",): np.array([y.min()]), ("max",): np.array([y.max()])}

    got = run_pass(rows, layout, work)
    if not got:
        return np.zeros((len(design.terms()) + 2,) * 2), 0, 0.0, 0.0
    return got["R",], int(got["sum",][0]), float(got["min",][0]), float(got["max",][0])


def fit_linear_model(frame: DataFrame, features: list[str], target: str, spec: StudySpec | None = None) -> LinearModel:
    """Least squares of a target on any columns: kinds from all rows, medians and levels from rows with a target."""
    from panelloom.plans.discovery import infer_kinds

    features = list(dict.fromkeys(features))
    kinds = infer_kinds(frame, features, spec or _ANY, {0: F.lit(True)})
    rows, layout = _rows(frame, target, features, kinds, [F.lit(TRAIN)])
    design = fit_designs(rows, layout, features, kinds)[0]
    r, n, _, _ = _factor(rows, layout, design)
    return LinearModel(target, design, fit_from_factor(r, n, ("__intercept__", *(t.name for t in design.terms()))))


def cross_validated_r2(frame: DataFrame, features: list[str], target: str, position: str, folds: int = 5, spec: StudySpec | None = None) -> tuple[float, list[float]]:
    """Mean and list of held-out R2 by position modulo folds."""
    fold = row_modulo_folds(F.col(position), folds)
    scores = [fit_linear_model(frame.where(fold != k), features, target, spec).r2(frame.where(fold == k)) for k in range(folds)]
    return float(np.mean(scores)), scores


def treatment_effects(frame: DataFrame, interventions: list[str], target: str, adjustments: list[str], estimand: str = "joint_conditional", spec: StudySpec | None = None) -> list[dict]:
    """Treatment records of a frame, all models from one factor."""
    from panelloom.plans.discovery import infer_kinds

    columns = list(dict.fromkeys([*interventions, *adjustments]))
    kinds = infer_kinds(frame, columns, spec or _ANY, {0: F.lit(True)})
    rows, layout = _rows(frame, target, columns, kinds, [F.lit(TRAIN)])
    design = fit_designs(rows, layout, columns, kinds)[0]
    r, n, _, _ = _factor(rows, layout, design)
    return treatment_records(JointFactor(r, n, design), interventions, target, adjustments, estimand)


def polynomial_terms(frame: DataFrame, columns: list[str], degree: int = 2, most: int = 3, fitted_on: DataFrame | None = None) -> DataFrame:
    """Adds products of up to `degree` of the first numeric columns, standardised as in `fitted_on` (the frame itself unless given)."""
    chosen = columns[:most]
    types = {f.name: f.dataType for f in frame.schema.fields}
    stats = (fitted_on or frame).agg(*[x for c in chosen for x in (F.avg(number(c, types[c])).alias(f"a_{c}"), F.stddev_pop(number(c, types[c])).alias(f"d_{c}"))]).first()
    z = {c: (number(c, types[c]) - F.lit(stats[f"a_{c}"])) / F.lit(stats[f"d_{c}"] or 1.0) for c in chosen}
    out, made = frame, {(): F.lit(1.0)}
    for _ in range(degree):
        made = {tuple(sorted((*k, c))): v * z[c] for k, v in made.items() for c in chosen}
        for k, v in made.items():
            if len(k) > 1:
                out = out.withColumn("poly_" + "_".join(k), v)
    return out


def _require_roles(frame: DataFrame, columns: list[str]) -> None:
    """A caller's splits: each a column of its own that is train, test or null, with rows on both sides."""
    if len(set(columns)) != len(columns) or set(columns) - set(frame.columns):
        raise ValueError("split columns must be different columns of the frame")
    counts = [F.count_if(x).alias(f"{k}:{n}") for k, c in enumerate(columns) for n, x in (("train", F.col(c) == "train"), ("test", F.col(c) == "test"), ("other", ~F.col(c).isin("train", "test")))]
    found = frame.agg(*counts).first().asDict()
    if wrong := [c for k, c in enumerate(columns) if not found[f"{k}:train"] or not found[f"{k}:test"] or found[f"{k}:other"]]:
        raise ValueError(f"splits {wrong} need training rows, test rows and no other role")


def score_states(
    frame: DataFrame, recipe: Recipe, outcome: str, target: str, micro: list[str], interventions: list[str], merges: tuple[tuple[int, int], ...] = (), folds: int = 5, position: str | None = None,
    split_columns: list[str] | None = None, paired: PairedScores | None = None, spec: StudySpec | None = None,
) -> tuple[Encoder, MacroScore]:
    """Fit a recipe on all rows and score it.

    Folds come from split_columns (train and test roles) or from position modulo folds; with `paired` the predictive scores
    are the caller's, and only the shares of variance are computed.
    """
    from panelloom.plans.discovery import infer_kinds

    if outcome not in frame.columns or target not in frame.columns:
        raise ValueError("the frame needs the outcome and the target")
    if split_columns:
        _require_roles(frame, split_columns)
        roles = [F.when(F.col(c) == "train", TRAIN).when(F.col(c) == "test", TEST).otherwise(0) for c in split_columns]
    elif paired is None:
        if position is None:
            raise ValueError("folds need split_columns or a position column")
        fold = row_modulo_folds(F.col(position), folds)
        roles = [F.when(fold == k, TEST).otherwise(TRAIN) for k in range(folds)]
    else:
        roles = []
    both = list(dict.fromkeys([*interventions, *micro]))
    columns = list(dict.fromkeys([*both, *recipe.columns]))
    where = {0: F.lit(True)} | {k + 1: r == TRAIN for k, r in enumerate(roles)}
    kinds = infer_kinds(frame, columns, spec or _ANY, where)
    if any(kinds[0][c] != "numeric" for c in recipe.columns):
        raise ValueError("states are made of numeric columns")
    rows, layout = _rows(frame, target, columns, kinds, [F.lit(TRAIN), *roles])
    fits = fit_recipes(rows, layout, [recipe])
    encoder = fits.by[recipe.recipe_id, 0]
    for left, right in merges:
        encoder = encoder.merged(left, right)
    designs = fit_designs(rows, layout, columns, kinds)
    sides = {0: (TRAIN,)} | {s: (TRAIN, TEST) for s in range(1, layout.splits)}
    factors = build_factors(rows, layout, fits, [recipe], designs, interventions, both, sides)
    if paired is None:
        score = factors.score(encoder, outcome, target)
        scope = GIVEN_SPLITS if split_columns else ROW_MODULO
        own = PairedScores(score.paired.macro, score.paired.micro, scope, score.paired.ids)
        return encoder, MacroScore(score.name, outcome, target, own, COMPUTED, score.validation_specificity, score.outcome_specificity, score.state_count, score.row_count, score.topologies)
    held = None
    if roles:
        states = [max(0.0, factors.macro_r2(replay(encoder, fits.by[recipe.recipe_id, s]), s, with_interventions=False)) for s in range(1, layout.splits)]
        held = min(1.0, float(np.mean(states)))
    return encoder, MacroScore(encoder.name, outcome, target, paired, DECLARED, held, factors.outcome_specificity(encoder), len(encoder.labels), factors.development_rows)
