"""The discovery plan: validate, lag, split, fit, search, rank, evaluate once, audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cells import category, is_numeric_text, number, present
from panelloom.operators import adjustment as adj
from panelloom.operators.encoders import Encoder
from panelloom.operators.factors import TEST, TRAIN, Factors, build_factors, fit_designs
from panelloom.operators.fitting import distinct_recipes, fit_recipes, list_recipes
from panelloom.operators.ols import held_out_r2
from panelloom.operators.panel import LEAD_TIME, build_lagged, validate_panel
from panelloom.operators.passes import Batch, Layout, Parts, run_pass, triangle
from panelloom.operators.scoring import COMPUTED, HELD_OUT, SCHEMA_VERSION, MacroScore
from panelloom.operators.search import search
from panelloom.operators.splits import OUTER, SplitPlan, fold_column, plan_splits
from panelloom.plans.spec import StudySpec, load_spec
from panelloom.runtime import scratch_for
from panelloom.sources.tables import read_panel


@dataclass(frozen=True)
class DiscoveryConfig:
    outcome: str | None = None
    lag: int = 1
    max_states: int = 6
    paths: int = 10
    branching_factor: int = 2
    folds: int = 5
    top_k: int = 10
    validation_mode: str = "entity_holdout"
    holdout_fraction: float = 0.2
    seed: int = 0
    split_hash: str = "permutation"


def discover_file(spark: SparkSession, panel: str, spec: str, config: DiscoveryConfig | None = None) -> dict:
    """Read a panel and a study, then discover."""
    return discover(read_panel(spark, panel), load_spec(spec), config)


def infer_kinds(frame: DataFrame, columns: list[str], spec: StudySpec, where: dict[int, Column]) -> list[dict[str, str]]:
    """Kinds of columns by split: declared, else from the split's training rows (one aggregate)."""
    open_ = [c for c in columns if spec.column(c).kind is None]
    types = {c: frame.schema[c].dataType for c in columns}
    checks = []
    for s, rows in where.items():
        for k, c in enumerate(open_):
            some = rows & present(c, types[c])
            checks += [F.count_if(some).alias(f"a{s}_{k}"), F.count_if(some & is_numeric_text(c, types[c])).alias(f"b{s}_{k}")]
    row = frame.agg(*checks).first() if checks else {}
    out = []
    for s in where:
        kinds = {}
        for c in columns:
            if c not in open_:
                kinds[c] = spec.column(c).kind
                continue
            k = open_.index(c)
            seen, numeric = row[f"a{s}_{k}"], row[f"b{s}_{k}"]
            kinds[c] = "numeric" if seen and seen == numeric and not isinstance(types[c], T.BooleanType) else "categorical"
        out.append(kinds)
    return out


def prepare(plan: SplitPlan, target: str, columns: list[str], kinds: list[dict[str, str]]) -> tuple[DataFrame, Layout]:
    """The planned panel as passes read it. Split 0 has development rows as training and the holdout as test rows."""
    numeric = [c for c in columns if any(k[c] == "numeric" for k in kinds)]
    categorical = [c for c in columns if any(k[c] != "numeric" for k in kinds)]
    frame, types = plan.frame, {f.name: f.dataType for f in plan.frame.schema.fields}
    code = lambda c: F.when(F.col(c) == "train", TRAIN).when(F.col(c) == "test", TEST).otherwise(0).cast("tinyint")
    roles = [code(OUTER).alias("__r0"), *(code(fold_column(k)).alias(f"__r{k}") for k in range(1, plan.folds + 1))]
    cells = [number(c, types[c]).alias(f"__n{j}") for j, c in enumerate(numeric)] + [category(c, types[c]).alias(f"__c{j}") for j, c in enumerate(categorical)]
    out = frame.where(F.col(OUTER).isin("train", "test")).select(number(target, types[target]).alias("__y"), *roles, *cells)
    return out, Layout(plan.folds + 1, tuple(numeric), tuple(categorical))


def transform_report(frame: DataFrame, columns: list[str], kinds: dict[str, str], levels: dict[str, tuple]) -> dict[str, dict[str, int]]:
    """Missing and invalid cells and unknown categories by column."""
    types, checks = {f.name: f.dataType for f in frame.schema.fields}, []
    for k, c in enumerate(columns):
        some = present(c, types[c])
        checks.append(F.count_if(~some).alias(f"m{k}"))
        if kinds[c] == "numeric":
            checks += [F.count_if(some & number(c, types[c]).isNull()).alias(f"i{k}"), F.lit(0).alias(f"u{k}")]
        else:
            known = [v for v in levels.get(c, ()) if v is not None]
            unknown = some & ~category(c, types[c]).isin(known) if known else some
            if None not in levels.get(c, ()):
                unknown = unknown | ~some
            checks += [F.lit(0).alias(f"i{k}"), F.count_if(unknown).alias(f"u{k}")]
    row = frame.agg(F.count("*").alias("n"), *checks).first()
    return {c: {"missing": row[f"m{k}"], "invalid_numeric": int(row[f"i{k}"] or 0), "unknown_category": int(row[f"u{k}"] or 0)} for k, c in enumerate(columns)}


def require_support(frame: DataFrame, layout: Layout) -> None:
    """Every inner side needs two targets, and test targets must differ; plans are never changed for it."""

    def count(batch: Batch) -> Parts:
        out: Parts = {}
        for s in range(1, layout.splits):
            for side in (TRAIN, TEST):
                y = batch.y[(batch.roles[:, s] == side) & np.isfinite(batch.y)]
                out["sum", s, side] = np.array([len(y)])
                if len(y):
                    out["min", s, side], out["max", s, side] = np.array([y.min()]), np.array([y.max()])
        return out

    found = run_pass(frame, layout, count)
    for s in range(1, layout.splits):
        for side, name in ((TRAIN, "train"), (TEST, "test")):
            n = int(found.get(("sum", s, side), np.zeros(1))[0])
            if n < 2 or (side == TEST and found["min", s, side][0] == found["max", s, side][0]):
                raise ValueError(f"fold {s}: {n} usable {name} targets cannot support an evaluation; the plan stays as it is")


def _joint_factor(frame: DataFrame, layout: Layout, factors: Factors, encoder: Encoder, columns: list[str]) -> adj.JointFactor:
    """The factor of treatments, adjustments and the final state over development rows with a target."""
    numeric, categorical = {c: j for j, c in enumerate(layout.numeric)}, {c: j for j, c in enumerate(layout.categorical)}
    base = factors.sub_design(0, columns)
    groups = factors.state_groups(encoder, 0)
    texts = tuple(str(encoder.state_map[g[0]]) for g in groups)
    index = [numeric[c] for c in encoder.recipe.columns]

    def work(batch: Batch) -> Parts:
        rows = (batch.roles[:, 0] == TRAIN) & np.isfinite(batch.y)
        if not rows.any():
            return {}
        raw = encoder.raw(batch.numbers[rows][:, index])
        hot = [np.isin(raw, g).astype(float) for g in groups[1:]]
        states = np.stack(hot, axis=1) if hot else np.zeros((int(rows.sum()), 0))
        block = [np.ones((int(rows.sum()), 1)), base.matrix(batch, rows, numeric, categorical), states, batch.y[rows][:, None]]
        return {("R",): triangle(np.hstack(block))}

    r = run_pass(frame, layout, work)[("R",)]
    design = type(base)((*base.columns, adj.MACRO), (*base.kinds, "categorical"), base.fills, {**base.levels, adj.MACRO: texts})
    return adj.JointFactor(r, factors.rows[0, TRAIN], design)


def discover(frame: DataFrame, spec: StudySpec, config: DiscoveryConfig | None = None, tie: tuple[str, ...] = ()) -> dict:
    """Run the whole plan; the result is strict JSON."""
    config = config or DiscoveryConfig()
    if config.top_k < 1 or config.max_states < 2:
        raise ValueError("top_k must be 1 or more and max_states 2 or more")
    summary = validate_panel(frame, spec)
    outcome = _outcome(spec, frame, config.outcome)
    lagged = build_lagged(frame, spec, [outcome], config.lag, tie)
    target = lagged.targets[outcome]
    scratch = scratch_for(frame.sparkSession, "discovery")
    plan = plan_splits(lagged.frame, spec.id_column, config.validation_mode, config.folds, config.holdout_fraction, config.seed, config.split_hash, tie)
    plan = SplitPlan(scratch.save(lambda: plan.frame, "planned"), plan.mode, plan.folds, plan.fraction, plan.seed, plan.split_hash)

    available = list(frame.columns)
    micro = spec.feature_columns(available)
    interventions = spec.intervention_columns(available)
    environments = spec.environment_columns(available)
    features = spec.macro_feature_columns(available) or [c for c in micro if c not in interventions]
    if not features:
        raise ValueError("there is no column that a macro state could be made of")
    resolved = adj.resolve_adjustment(spec, [*available, target], interventions, target)
    estimand = adj.resolve_estimand(spec)
    columns = list(dict.fromkeys([*micro, *interventions, *features, *resolved["columns"]]))
    train = {0: F.col(OUTER) == "train"} | {k: F.col(fold_column(k)) == "train" for k in range(1, config.folds + 1)}
    kinds = infer_kinds(plan.frame, columns, spec, train)
    rows, layout = prepare(plan, target, columns, kinds)
    rows = scratch.save(lambda: rows, "rows")
    development = rows.where("__r0 = 1")
    require_support(development, layout)

    numeric = [c for c in features if kinds[0][c] == "numeric"]
    recipes = list_recipes(numeric, config.max_states)
    fits = fit_recipes(development, layout, recipes) if recipes else None
    starts = distinct_recipes(development, layout, fits) if recipes else []
    if not starts:
        raise ValueError("no candidate states could be made")
    both = list(dict.fromkeys([*interventions, *micro]))
    designs = fit_designs(development, layout, columns, kinds)
    inner = {0: (TRAIN,)} | {s: (TRAIN, TEST) for s in range(1, layout.splits)}
    factors = build_factors(development, layout, fits, starts, designs, interventions, both, inner)
    score = lambda e: factors.score(e, outcome, target)
    searches = [search(fits.by[r.recipe_id, 0], score, config.paths, config.branching_factor) for r in starts]
    best = sorted((s.best for s in searches if s.best is not None), key=lambda n: n.score.rank_key, reverse=True)[: config.top_k]
    if not best:
        raise ValueError("no candidate can be scored on every fold")
    winner = best[0].encoder
    evaluation = _evaluate(rows, plan, layout, factors, winner, target, interventions, both, kinds[0])
    audit = _audit(plan, rows, layout, factors, winner, spec, resolved, estimand, interventions, target)
    documents = [s.to_dict() for s in searches]
    top = [n["best"] for n in documents if n["best"]]
    top = sorted(top, key=lambda r: (r["ranking_score"], r["specificity"], r["state_count"], r["macro_name"]), reverse=True)[: config.top_k]
    holdout = plan.frame.where(F.col(OUTER) == "test")
    applied = transform_report(holdout, columns, kinds[0], designs[0].levels)
    warnings = ["These are hypotheses: they need a review of the design, sensitivity checks and validation by the field."]
    if not interventions:
        warnings.append("No intervention was declared, so there are no pathway estimates.")
    if not environments:
        warnings.append("No environment was declared, so invariance is not checked.")
    return {
        "library": "panelloom",
        "schema_version": SCHEMA_VERSION,
        "status": "experimental_hypothesis_generation",
        "assumptions": [
            "Rows are repeated observations of entities over time.",
            "A lag counts rows within an entity, not calendar time.",
            "The validation mode says what is estimated; training leads stay on their side of every border.",
            "Recipes are ranked on development rows; the chosen one is evaluated once on the holdout.",
            "Coefficients are observational and conditional on declared adjustments; they prove no cause.",
            "The ranking is a heuristic preference.",
        ],
        "score_semantics": {
            "schema_version": SCHEMA_VERSION,
            "ranking_score": "heuristic preference, no statistic of emergence",
            "specificity": HELD_OUT,
            "outcome_specificity": "descriptive share of in-sample variance between states",
            "predictive_comparison": "raw paired difference of macro and micro R2",
            "predictive_provenance": COMPUTED,
            "emergence_evidence_status": "not_assessed",
        },
        "panel": {"row_count": summary.row_count, "entity_count": summary.entity_count, "duplicate_entity_times": summary.duplicate_entity_times, "warnings": list(summary.warnings)},
        "config": asdict(config) | {"outcome": outcome},
        "columns": {"micro_features": micro, "macro_features": features, "interventions": interventions, "environments": environments, "target": target},
        "top_macros": [r | {"evaluation_scope": "development_selection_only"} for r in top],
        "candidate_pathways": audit["pathways"],
        "adjustment": audit,
        "validation": _validation(plan, spec.id_column, lagged.eligible[outcome]),
        "feature_schema": {
            c: {
                "kind": kinds[0][c],
                "source": "declared" if spec.column(c).variable_type else "outer_training_inference",
                "invalid_outer_values": applied[c]["invalid_numeric"],
                "unknown_outer_categories": applied[c]["unknown_category"],
                "missing_outer_values": applied[c]["missing"],
            }
            for c in columns
        },
        "outer_evaluation": evaluation,
        "searches": documents,
        "warnings": [*warnings, *audit["warnings"], *([evaluation["reason"]] if evaluation["status"] == "not_evaluable" else [])],
    }


def _outcome(spec: StudySpec, frame: DataFrame, requested: str | None) -> str:
    if requested:
        if requested not in frame.columns:
            raise ValueError(f"the panel has no outcome {requested!r}")
        return requested
    listed = spec.outcome_columns(frame.columns)
    if len(listed) != 1:
        raise ValueError(f"the study has {len(listed)} outcomes: name one")
    return listed[0]


def _validation(plan: SplitPlan, id_column: str, eligible: str) -> dict:
    text = lambda v: v if isinstance(v, (int, float, type(None))) else str(v)
    out = {"mode": plan.mode, "folds": plan.folds, "holdout_fraction": plan.fraction, "seed": plan.seed, "split_hash": plan.split_hash, "selection_columns": [id_column, "time", LEAD_TIME], "splits": {}}
    for r in plan.coverage(id_column).collect():
        out["splits"].setdefault(r["split"], {})[r["role"]] = {k: text(v) for k, v in r.asDict().items() if k not in ("split", "role")}
    support: dict = {}
    for r in plan.target_support(eligible).collect():
        support.setdefault(r["split"], {})[r["role"]] = {k: r[k] for k in ("reserved", "usable", "ineligible")}
    out["target_support"] = support
    out["entity_overlap"] = plan.overlap(id_column).first().asDict()
    if plan.mode == "interpolation":
        out["interpretation_limit"] = "rows within known trajectories: nothing is said about new entities or the future"
    return out


def _evaluate(rows: DataFrame, plan: SplitPlan, layout: Layout, factors: Factors, winner: Encoder, target: str, interventions: list[str], both: list[str], kinds: dict[str, str]) -> dict:
    """The one look at the holdout."""
    held = build_factors(rows.where("__r0 = 2"), layout, factors.fits, [winner.recipe], factors.designs, interventions, both, {0: (TEST,)})
    numeric = {c: j for j, c in enumerate(layout.numeric)}
    index = [numeric[c] for c in winner.recipe.columns]
    sizes = run_pass(
        rows.where("__r0 = 2"),
        layout,
        lambda b: {("sum", "raw"): np.bincount(winner.raw(b.numbers[:, index]), minlength=winner.raw_states), ("sum", "rows"): np.array([len(b.y), np.isfinite(b.y).sum()])},
    )
    raw = sizes.get(("sum", "raw"), np.zeros(winner.raw_states, int))
    total, usable = (int(x) for x in sizes.get(("sum", "rows"), np.zeros(2, int)))
    by_label: dict[int, int] = {}
    for k, n in enumerate(raw):
        if n:
            by_label[winner.state_map[k]] = by_label.get(winner.state_map[k], 0) + int(n)
    fit, groups = factors.macro_fit(winner, 0)
    micro = factors.micro_fit(0)
    holdout = plan.frame.where(F.col(OUTER) == "test")
    levels = factors.designs[0].levels
    out = {
        "scope": "untouched_outer_holdout_selected_macro",
        "macro_name": winner.name,
        "status": "not_evaluable",
        "macro_r2": None,
        "micro_r2": None,
        "predictive_r2_difference": None,
        "train_rows": factors.development_rows,
        "test_rows": total,
        "finite_train_targets": factors.rows[0, TRAIN],
        "finite_test_targets": usable,
        "nonfinite_test_targets_excluded": total - usable,
        "metric_weighting": "rows weigh equally within a split, folds equally in means",
        "training_state_count": len(winner.labels),
        "holdout_state_sizes": {str(k): v for k, v in sorted(by_label.items())},
        "unseen_state_rows": sum(n for k, n in by_label.items() if k not in winner.labels),
        "encoder": winner.to_dict(),
        "feature_application": {
            "macro_encoder": transform_report(holdout, list(winner.recipe.columns), kinds, levels),
            "micro_design": transform_report(holdout, both, kinds, levels),
        },
        "note": "predictive figures of the chosen recipe; negative R2 is kept",
    }
    if usable < 2:
        return out | {"reason": f"the holdout has {usable} usable targets in {total} rows, two are needed; it was not replaced"}
    low, high = held.low[0, TEST], held.high[0, TEST]
    if low == high:
        return out | {"reason": "the holdout's target is constant, R2 is undefined; it was not replaced"}
    held.state_rows |= {(winner.recipe.recipe_id, 0, TRAIN): factors.state_rows[winner.recipe.recipe_id, 0, TRAIN]}
    from panelloom.operators.ols import merge_columns

    macro_r2 = held_out_r2(fit, merge_columns(held.r["macro", winner.recipe.recipe_id, 0, TEST], factors.head(0), groups[1:]), usable, low, high)
    micro_r2 = held_out_r2(micro, held.r["micro", 0, TEST], usable, low, high)
    return out | {"status": "evaluated", "macro_r2": macro_r2, "micro_r2": micro_r2, "predictive_r2_difference": macro_r2 - micro_r2}


def _audit(plan: SplitPlan, rows: DataFrame, layout: Layout, factors: Factors, winner: Encoder, spec: StudySpec, resolved: dict, estimand: str, interventions: list[str], target: str) -> dict:
    """The adjustment audit on development rows."""
    declared = resolved["columns"]
    columns = list(dict.fromkeys([*interventions, *declared]))
    factor = _joint_factor(rows, layout, factors, winner, columns)
    frame = plan.frame.where(F.col(OUTER) == "train")
    types = {f.name: f.dataType for f in frame.schema.fields}
    cells = {c: number(c, types[c]).alias(f"a{k}") for k, c in enumerate(columns)}
    state = winner.column([number(c, types[c]) for c in winner.recipe.columns]).alias("state")
    narrow = frame.select(*cells.values(), state)
    names = {c: f"a{k}" for k, c in enumerate(columns)}
    residuals = adj.residual_diagnostics(narrow, {c: names[c] for c in declared}, {c: names[c] for c in interventions}, "state") if declared else []
    distinct = frame.agg(*[F.countDistinct(f"`{c}`").alias(names[c]) for c in declared]).first().asDict() if declared else {}
    macro = {"name": winner.name, "states": len(winner.labels), "feature_columns": list(winner.recipe.columns)}
    return adj.sufficiency_audit(spec, factor, resolved, interventions, target, estimand, macro, residuals, {c: distinct[names[c]] for c in declared})


def score_records(scores: list[MacroScore]) -> list[dict]:
    return [s.to_dict() for s in sorted(scores, key=lambda s: s.rank_key, reverse=True)]
