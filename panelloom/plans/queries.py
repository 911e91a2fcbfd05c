"""Queries over the given tables and the same questions in DuckDB's SQL.

Floating results are rounded on both sides; counts are 64-bit on both sides. Queries without SQL are iterative or
algebraic; tests hold them against NumPy.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.cells import number
from panelloom.operators.encoders import COMPOSITE, KMEANS, Encoder, Recipe
from panelloom.operators.fitting import first_appearance, fit_recipes, list_recipes
from panelloom.operators.ols import fit_from_factor, held_out_r2
from panelloom.operators.panel import build_lagged, summary_frame
from panelloom.operators.passes import Batch, Layout, run_pass, triangle
from panelloom.operators.scoring import COMPUTED, DECLARED, MacroScore, PairedScores, compression_score, fold_stability, variance_share
from panelloom.operators.splits import OUTER, SplitPlan, fold_column, plan_splits
from panelloom.plans.spec import StudySpec
from panelloom.runtime import scratch_for
from panelloom.sources.panels import event_panel, exact_mean, order_panel, supplier_month_panel, turn_panel, user_day_panel

EVENTS = StudySpec.from_dict({"id_column": "user_id", "time_column": "ts", "outcomes": ["value"], "columns": {"value": {"role": "outcome", "type": "numeric", "allowed_as_cause": False, "allowed_as_adjustment": False}, "k": {"type": "numeric"}}, "exclude": ["event_id"]})
DAYS = StudySpec.from_dict({"id_column": "user_id", "time_column": "day", "outcomes": ["y"], "columns": {"y": {"role": "outcome", "type": "numeric", "allowed_as_cause": False, "allowed_as_adjustment": False}}})
SUPPLIERS = StudySpec.from_dict(
    {
        "id_column": "l_suppkey", "time_column": "month", "outcomes": ["y"], "interventions": ["discount"],
        "columns": {"y": {"role": "outcome", "type": "numeric", "allowed_as_cause": False, "allowed_as_adjustment": False}, "tax": {"role": "covariate", "type": "numeric"}},
        "adjustment": {"columns": ["tax"], "rationale": "tax is set beside the discount"},
    }
)
SEED = 17


def _round(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_lagged(event_panel(spark, sf_dir), EVENTS, lag=1, tie=("event_id",)).frame


def _suppliers(spark: SparkSession, sf_dir: str, lag: int = 1, outcomes: list[str] | None = None) -> DataFrame:
    return build_lagged(supplier_month_panel(spark, sf_dir), SUPPLIERS, outcomes, lag).frame


def _rows(frame: DataFrame, target: str, numeric: list[str], roles: list[Column]) -> tuple[DataFrame, Layout]:
    types = {f.name: f.dataType for f in frame.schema.fields}
    cells = [number(c, types[c]).alias(f"__n{j}") for j, c in enumerate(numeric)]
    out = frame.select(number(target, types[target]).alias("__y"), *[r.cast("tinyint").alias(f"__r{k}") for k, r in enumerate(roles)], *cells)
    return out, Layout(len(roles), tuple(numeric), ())


def _encoders(frame: DataFrame, target: str, numeric: list[str], recipes: list[Recipe]) -> dict[int, Encoder]:
    """Recipes fitted on all rows."""
    rows, layout = _rows(frame, target, numeric, [F.lit(1)])
    # fitting reads its narrow rows many times: the lead's shuffle is not repeated
    rows = scratch_for(frame.sparkSession, "encoders").save(lambda: rows, "rows")
    fits = fit_recipes(rows, layout, recipes)
    return {r.recipe_id: fits.by[r.recipe_id, 0] for r in recipes}


def _state(frame: DataFrame, encoder: Encoder) -> Column:
    types = {f.name: f.dataType for f in frame.schema.fields}
    return encoder.column([number(c, types[c]) for c in encoder.recipe.columns])


# Panel


def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_frame(order_panel(spark, sf_dir), "o_custkey", "o_orderdate").select("row_count", "entity_count", "duplicate_entity_times")


def lagged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _events(spark, sf_dir)
    return out.select("user_id", "event_id", "value", "k", "value__lead1", F.col("__lead_time").alias("lead_time"))


def lagged_lag2_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _suppliers(spark, sf_dir, 2, ["y", "quantity"])
    return out.select("l_suppkey", "month", _round("y__lead2", 2).alias("y__lead2"), _round("quantity__lead2", 2).alias("quantity__lead2"), F.col("__lead_time").alias("lead_time"))


def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = supplier_month_panel(spark, sf_dir).withColumn("y", F.when(F.month("month") % 5 != 0, F.col("y")))
    out = build_lagged(panel, SUPPLIERS).frame
    return out.agg(F.count("*").alias("n_rows"), F.count_if("__target_eligible__y").alias("usable"), F.count_if(~F.col("__target_eligible__y")).alias("ineligible"))


def turn_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = StudySpec.from_dict({"id_column": "conv_id", "time_column": "turn", "outcomes": ["y"]})
    out = build_lagged(turn_panel(spark, sf_dir), spec).frame
    return out.groupBy("role").agg(F.count("*").alias("n"), _round(F.avg("y__lead1")).alias("mean_next"))


# Splits


def _plan(spark: SparkSession, sf_dir: str, mode: str, folds: int = 3) -> SplitPlan:
    if mode == "entity_holdout":
        return plan_splits(_events(spark, sf_dir), "user_id", mode, folds, 0.2, SEED, "md5")
    if mode == "forward_time":
        return plan_splits(build_lagged(user_day_panel(spark, sf_dir), DAYS).frame, "user_id", mode, folds, 0.25)
    return plan_splits(_suppliers(spark, sf_dir), "l_suppkey", mode, folds, 0.25)


def entity_outer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "entity_holdout").frame.groupBy("user_id", F.col(OUTER)).agg(F.count("*").alias("n"))


def entity_inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plan(spark, sf_dir, "entity_holdout").frame.where(F.col(OUTER) == "train")
    fold = F.when(F.col("fold_1") == "test", 1).when(F.col("fold_2") == "test", 2).otherwise(3).cast("long")
    return out.groupBy("user_id", fold.alias("fold")).agg(F.count("*").alias("n"))


def forward_outer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plan(spark, sf_dir, "forward_time").frame
    return out.groupBy("day", F.col(OUTER)).agg(F.count("*").alias("n"))


def forward_inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plan(spark, sf_dir, "forward_time").frame.where(F.col(OUTER) == "train")
    return out.groupBy("day", *[fold_column(k) for k in (1, 2, 3)]).agg(F.count("*").alias("n"))


def interpolation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "interpolation").frame.select("l_suppkey", "month", OUTER)


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _plan(spark, sf_dir, "forward_time").coverage("user_id")
    return out.select("split", "role", "rows", "entities", "first_time", "last_time", "last_target_time")


# Encoders


def _quantile(bins: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = _events(spark, sf_dir)
        e = _encoders(frame, "value__lead1", ["k"], [Recipe(0, "quantile", ("k",), bins)])[0]
        return frame.select("user_id", "event_id", _state(frame, e).cast("long").alias("state"))

    return run


def composite_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, columns = _suppliers(spark, sf_dir), ("quantity", "discount", "tax")
    e = _encoders(frame, "y__lead1", list(columns), [Recipe(0, COMPOSITE, columns, 3)])[0]
    return frame.groupBy(_state(frame, e).cast("long").alias("state")).agg(F.count("*").alias("n"))


def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _events(spark, sf_dir)
    e = _encoders(frame, "value__lead1", ["k"], [Recipe(0, "quantile", ("k",), 3)])[0].merged(0, 1)
    return frame.select("user_id", "event_id", _state(frame, e).cast("long").alias("state"))


def state_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile(3)(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen centers applied as an expression; means are exact, since months lie at equal distances from two centers."""
    centers = ((-1.0, 0.5), (0.0, -0.75), (1.25, 0.25))
    e = Encoder(Recipe(0, KMEANS, ("quantity", "tax"), 3), (600.0, 0.04), (600.0, 0.04), (200.0, 0.01), centers=centers)
    frame = build_lagged(supplier_month_panel(spark, sf_dir, exact_mean), SUPPLIERS).frame
    return frame.groupBy(_state(frame, e).cast("long").alias("state")).agg(F.count("*").alias("n"))


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers and sizes of a k-means fit."""
    frame, columns = _suppliers(spark, sf_dir), ("quantity", "discount", "tax")
    e = _encoders(frame, "y__lead1", list(columns), [Recipe(0, KMEANS, columns, 3)])[0]
    rows = [(k, *map(float, c), n) for k, (c, n) in enumerate(zip(e.centers, e.occupied, strict=True))]
    return spark.createDataFrame(rows, "state long, z_quantity double, z_discount double, z_tax double, n long")


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types renumbered by their first event."""
    return first_appearance(event_panel(spark, sf_dir), "event_type", "event_id").select("event_type", F.col("canonical").cast("long").alias("canonical")).distinct()


# Regression


def _linear(frame: DataFrame, target: str, features: list[str], train: Column, test: Column | None = None) -> dict:
    """A fit and, with test rows, its held-out R2."""
    role = F.when(train, 1).when(test, 2).otherwise(0) if test is not None else F.when(train, 1).otherwise(0)
    rows, layout = _rows(frame, target, features, [role])

    def work(b: Batch) -> dict:
        out = {}
        for side in (1, 2):
            at = (b.roles[:, 0] == side) & np.isfinite(b.y) & np.isfinite(b.numbers).all(axis=1)
            if at.any():
                out["R", side] = triangle(np.column_stack([np.ones(at.sum()), b.numbers[at], b.y[at]]))
                out["sum", side], out["min", side], out["max", side] = (np.array([x]) for x in (at.sum(), b.y[at].min(), b.y[at].max()))
        return out

    got = run_pass(rows, layout, work)
    fit = fit_from_factor(got["R", 1], int(got["sum", 1][0]), ("__intercept__", *features))
    r2 = held_out_r2(fit, got["R", 2], int(got["sum", 2][0]), got["min", 2][0], got["max", 2][0]) if test is not None else None
    return {"fit": fit, "r2": r2}


def simple_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _linear(_suppliers(spark, sf_dir), "y__lead1", ["quantity"], F.lit(True))["fit"]
    row = (round(float(fit.beta[1]), 4), round(float(fit.beta[0]), 2), round(fit.r2, 6), fit.nobs)
    return spark.createDataFrame([row], "slope double, intercept double, r2 double, n long")


def joint_two_treatment_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _linear(_suppliers(spark, sf_dir), "y__lead1", ["quantity", "n"], F.lit(True))["fit"]
    return spark.createDataFrame([(round(float(fit.beta[1]), 3), round(float(fit.beta[2]), 1), fit.rank)], "b_quantity double, b_n double, design_rank long")


def treatment_stderr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients with IID standard errors and estimability; tax_copy is aliased on purpose."""
    frame = _suppliers(spark, sf_dir).withColumn("tax_copy", F.col("tax") * 2)
    fit = _linear(frame, "y__lead1", ["discount", "tax", "tax_copy", "n"], F.lit(True))["fit"]
    rows = [(n, None if not ok else float(c), None if not np.isfinite(s) else float(s), bool(ok)) for n, c, s, ok in zip(fit.names, fit.coefficients, fit.stderr, fit.estimable, strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double, stderr double, estimable boolean")


def heldout_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir, "entity_holdout").frame
    r2 = _linear(p, "value__lead1", ["k"], F.col(OUTER) == "train", F.col(OUTER) == "test")["r2"]
    return spark.createDataFrame([(round(r2, 8),)], "r2 double")


def design_transform_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, invalid and unknown cells of held-out events under what training events fixed."""
    from panelloom.plans.discovery import transform_report

    p = _plan(spark, sf_dir, "entity_holdout").frame
    p = p.withColumn("k_text", F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit("bad")).otherwise(F.col("k").cast("string")))
    levels = [r[0] for r in p.where((F.col(OUTER) == "train") & (F.col("event_type") != "click")).select("event_type").distinct().collect()]
    out = transform_report(p.where(F.col(OUTER) == "test"), ["k_text", "event_type"], {"k_text": "numeric", "event_type": "categorical"}, {"event_type": tuple(levels)})
    return spark.createDataFrame([(c, v["missing"], v["invalid_numeric"], v["unknown_category"]) for c, v in out.items()], "column_name string, missing long, invalid_numeric long, unknown_category long")


# Scores


def _state_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _events(spark, sf_dir)
    e = _encoders(frame, "value__lead1", ["k"], [Recipe(0, "quantile", ("k",), 2)])[0]
    return frame.withColumn("state", _state(frame, e))


def _share(frame: DataFrame, state: str, target: str) -> tuple[float, int, int]:
    """(between-state share of the target's variance, states, rows): moments of each state, then the library's formula."""
    states = frame.where(F.col(target).isNotNull()).groupBy(state).agg(F.count(target).alias("n"), F.avg(target).alias("m")).collect()  # a row for each state
    total = frame.agg(F.var_pop(target).alias("v")).first()["v"]
    counts, means = np.array([r["n"] for r in states], float), np.array([r["m"] for r in states])
    return variance_share(counts, means, total), len(states), int(counts.sum())


def outcome_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, _, _ = _share(_state_frame(spark, sf_dir), "state", "value__lead1")
    return spark.createDataFrame([(round(share, 9),)], "eta2 double")


def validation_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out R2 of training means of states, by inner fold; states are fixed at k above 49.5."""
    p = _plan(spark, sf_dir, "entity_holdout").frame.where(F.col(OUTER) == "train").withColumn("state", (F.col("k") > 49.5).cast("double"))
    rows = []
    for k in (1, 2, 3):
        r2 = _linear(p, "value__lead1", ["state"], F.col(fold_column(k)) == "train", F.col(fold_column(k)) == "test")["r2"]
        rows.append((k, round(r2, 8)))
    return spark.createDataFrame(rows, "fold long, r2 double")


def _fold_scores(spark: SparkSession, sf_dir: str) -> list[float]:
    return [r["r2"] for r in validation_specificity(spark, sf_dir).orderBy("fold").collect()]


def _states_and_rows(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = _state_frame(spark, sf_dir).agg(F.countDistinct("state").alias("s"), F.count("*").alias("n")).first()
    return row["s"], row["n"]


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(fold_stability(_fold_scores(spark, sf_dir)), 6),)], "stability double")


def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(compression_score(*_states_and_rows(spark, sf_dir)), 9),)], "compression double")


def ranking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a record: specificity by held-out folds."""
    folds = tuple(_fold_scores(spark, sf_dir))
    states, rows = _states_and_rows(spark, sf_dir)
    held_out = float(np.mean([max(x, 0.0) for x in folds]))
    record = MacroScore("half", "value", "value__lead1", PairedScores(folds, (0.0,) * len(folds), "inner folds"), COMPUTED, held_out, 0.0, states, rows)
    return spark.createDataFrame([(round(record.ranking_score, 6),)], "ranking_score double")


def residual_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.operators.adjustment import residual_diagnostics

    f = _suppliers(spark, sf_dir).withColumn("state", (F.col("quantity") > 600).cast("int"))
    one = residual_diagnostics(f, {"tax": "tax"}, {"discount": "discount"}, "state")[0]
    row = (round(one["within_macro_variance_fraction_remaining"], 8), round(one["treatment_covariate_residual_correlations"][0]["residual_correlation"], 8))
    return spark.createDataFrame([row], "fraction_remaining double, residual_correlation double")


def coarsening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with more values than the state that stands for them."""
    from panelloom.operators.adjustment import coarsened

    row = _state_frame(spark, sf_dir).agg(F.countDistinct("k").alias("k"), F.countDistinct("state").alias("s")).first()
    found = coarsened({"states": row["s"]}, {"k": row["k"]}, ["k"])
    return spark.createDataFrame([(x["observed_values"], x["macro_states"]) for x in found], "observed_values long, macro_states long")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank key's order over a few candidates: half and tercile states of several columns, by share and compression."""
    f = _suppliers(spark, sf_dir)
    recipes = [r for r in list_recipes(["quantity", "discount", "tax"], 3) if r.kind == "quantile"]
    fitted = _encoders(f, "y__lead1", ["quantity", "discount", "tax"], recipes)
    records = []
    for e in fitted.values():
        share, states, rows = _share(f.select("y__lead1", _state(f, e).alias("state")), "state", "y__lead1")
        records.append(MacroScore(e.name, "y", "y__lead1", PairedScores((0.0, 0.0), (0.0, 0.0), "none"), DECLARED, None, share, states, rows))
    best = sorted(records, key=lambda s: s.rank_key, reverse=True)[:4]
    return spark.createDataFrame([(s.name, s.state_count, round(s.outcome_specificity, 8)) for s in best], "name string, states long, eta2 double")


def next_value_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: do next values differ between low and high k?"""
    f = _state_frame(spark, sf_dir)
    return f.groupBy(F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"), _round(F.avg("value__lead1"), 6).alias("mean_next"), _round(F.stddev_pop("value__lead1"), 6).alias("sd_next"))


# Whole plans


def _discovery(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from panelloom.plans.discovery import DiscoveryConfig, discover

    panel, spec = (user_day_panel(spark, sf_dir), DAYS) if mode == "forward_time" else (supplier_month_panel(spark, sf_dir), SUPPLIERS)
    panel = scratch_for(spark, "panel").save(lambda: panel, "panel")
    d = discover(panel, spec, DiscoveryConfig(max_states=3, paths=2, folds=3, validation_mode=mode, holdout_fraction=0.25, seed=SEED, split_hash="md5" if mode == "entity_holdout" else "permutation"))
    rows = [(k, r["macro_name"], float(r["ranking_score"]), float(r["macro_r2"]), float(r["micro_r2"]), int(r["state_count"])) for k, r in enumerate(d["top_macros"])]
    return spark.createDataFrame(rows, "rank long, macro_name string, ranking_score double, macro_r2 double, micro_r2 double, state_count long")


def discovery_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovery(spark, sf_dir, "entity_holdout")


def discovery_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovery(spark, sf_dir, "forward_time")


def adjustment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-only against declared coefficients of the treatment."""
    from panelloom.plans.discovery import DiscoveryConfig, discover

    panel = scratch_for(spark, "panel").save(lambda: supplier_month_panel(spark, sf_dir), "panel")
    d = discover(panel, SUPPLIERS, DiscoveryConfig(max_states=2, paths=1, folds=2, validation_mode="interpolation", holdout_fraction=0.25, seed=SEED))
    rows = [(c["intervention"], c["macro_only_coefficient"], c["declared_adjustment_coefficient"], json.dumps(c["term_metadata"])) for c in d["adjustment"]["comparison"]["coefficient_changes"]]
    return spark.createDataFrame(rows, "intervention string, macro_only double, declared double, term string")


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the treatment's coefficient over resampled entities."""
    from panelloom.plans.study import cluster_bootstrap_interval

    f = _suppliers(spark, sf_dir)
    low, high, used = cluster_bootstrap_interval(f, "l_suppkey", "y__lead1", "discount", ["tax"], draws=200, seed=SEED)
    return spark.createDataFrame([(low, high, used)], "low double, high double, draws long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "next_value_by_state": next_value_by_state,
    "panel_summary": panel_summary,
    "lagged_table": lagged_table,
    "lagged_lag2_multi": lagged_lag2_multi,
    "eligibility_counts": eligibility_counts,
    "turn_leads": turn_leads,
    "entity_outer_split": entity_outer_split,
    "entity_inner_folds": entity_inner_folds,
    "forward_outer_split": forward_outer_split,
    "forward_inner_folds": forward_inner_folds,
    "interpolation_split": interpolation_split,
    "split_coverage": split_coverage,
    "quantile_q2": _quantile(2),
    "quantile_q3": _quantile(3),
    "composite_q3": composite_q3,
    "merged_states": merged_states,
    "state_sizes": state_sizes,
    "kmeans_assign": kmeans_assign,
    "kmeans_fit": kmeans_fit,
    "canonical_labels": canonical_labels,
    "simple_ols": simple_ols,
    "joint_two_treatment_ols": joint_two_treatment_ols,
    "treatment_stderr": treatment_stderr,
    "heldout_r2": heldout_r2,
    "design_transform_report": design_transform_report,
    "outcome_specificity": outcome_specificity,
    "validation_specificity": validation_specificity,
    "stability": stability,
    "compression": compression,
    "ranking_score": ranking_score,
    "residual_correlation": residual_correlation,
    "coarsening": coarsening,
    "top_k": top_k,
    "discovery_entity": discovery_entity,
    "discovery_forward": discovery_forward,
    "adjustment_audit": adjustment_audit,
    "cluster_bootstrap": cluster_bootstrap,
}
