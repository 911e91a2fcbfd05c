"""Specs, cells, leads and split plans."""

import functools
import itertools
import operator

import numpy as np
import pytest

from panelloom.operators.panel import build_lagged, validate_panel
from panelloom.operators.splits import OUTER, fold_column, plan_splits
from panelloom.plans.discovery import infer_kinds
from panelloom.plans.queries import kmeans_assign
from panelloom.plans.spec import AdjustmentSpec, ColumnSpec, StudySpec, kind_of_type, load_spec
from panelloom.sources.panels import exact_mean
from panelloom.sources.tables import JsonLines, read_panel_csv, strict_json

SPEC = StudySpec.from_dict({"id_column": "well", "time_column": "day", "outcomes": ["level"], "interventions": ["pump"]})
ROWS = [(7, 20, 1, -3.25), (7, 21, 0, -2.0), (9, 4, 0, 40.5), (9, 5, 0, 41.75), (9, 9, 1, 39.0), (9, 12, 1, 36.5), (11, 1, 0, 5.0)]
DDL = "well long, day long, pump long, level double"


def long_panel(entities=12, periods=10, lag=1):
    return [(e, t, float(e * t % 7), float(t)) for e in range(entities) for t in range(periods)]


def test_lead(spark):
    out = build_lagged(spark.createDataFrame(ROWS, DDL), SPEC)
    assert [(r.well, r.day, r.level__lead1) for r in out.frame.orderBy("well", "day").collect()] == [(7, 20, -2.0), (9, 4, 41.75), (9, 5, 39.0), (9, 9, 36.5)]
    assert out.targets == {"level": "level__lead1"}


def test_missing_targets_keep_their_rows(spark):
    gaps = {(2, 9): None, (4, 12): float("nan"), (4, 15): float("-inf"), (5, 0): None}  # the last one is no row's target
    rows = [(e, 3 * t, 0, gaps.get((e, 3 * t), float(e - t))) for e in (2, 4, 5, 6) for t in range(7)]
    out = build_lagged(spark.createDataFrame(rows, DDL), SPEC, lag=3).frame
    assert out.count() == 16 and out.where("not __target_eligible__level").count() == 3


def test_big_integer_times_stay_exact(spark):
    big = 2**62
    out = build_lagged(spark.createDataFrame([(1, big + k, 0, 1.0) for k in range(3)], DDL), SPEC).frame
    assert sorted(r["__lead_time"] for r in out.collect()) == [big + 1, big + 2]


@pytest.mark.parametrize("rows", [[(None, 1, 0, 1.0)], [(1, None, 0, 1.0)]])
def test_missing_keys_are_errors(spark, rows):
    with pytest.raises(ValueError):
        validate_panel(spark.createDataFrame(rows, DDL), SPEC)


def test_validation(spark):
    s = validate_panel(spark.createDataFrame([*ROWS, (9, 5, 1, 0.5), (9, 5, 1, 0.25)], DDL), SPEC)
    assert (s.row_count, s.entity_count, s.duplicate_entity_times, len(s.warnings)) == (9, 3, 2, 1)
    with pytest.raises(ValueError):
        validate_panel(spark.createDataFrame([(1, 1)], "well long, day long"), SPEC)
    with pytest.raises(ValueError):
        build_lagged(spark.createDataFrame(ROWS, DDL), SPEC, lag=0)
    with pytest.raises(ValueError):
        build_lagged(spark.createDataFrame([(1, 1, 0, 1.0, 1)], DDL + ", __lead_time long"), SPEC)


def test_duplicates_fail_the_plan(spark):
    frame = spark.createDataFrame([(e, t, 0, 1.0) for e in range(4) for t in (1, 1, 2, 3)], DDL)
    with pytest.raises(ValueError, match="target time"):
        plan_splits(build_lagged(frame, SPEC).frame, "well")


def test_textual_times(spark):
    spec = StudySpec.from_dict({"id_column": "i", "time_column": "t", "outcomes": ["y"]})
    frame = spark.createDataFrame([("a", "10", 3.0), ("a", "9", 2.0), ("a", "2", 1.0)], "i string, t string, y double")
    assert [r.y__lead1 for r in build_lagged(frame, spec).frame.orderBy("__panel_t").collect()] == [2.0, 3.0]
    with pytest.raises(ValueError):
        build_lagged(spark.createDataFrame([("a", "soon", 1.0)], "i string, t string, y double"), spec)


def lagged(spark, rows=None):
    spec = StudySpec.from_dict({"id_column": "person", "time_column": "week", "outcomes": ["score"]})
    return build_lagged(spark.createDataFrame(rows or long_panel(), "person long, week long, x double, score double"), spec).frame


def test_entity_plan_is_the_seeded_permutation(spark):
    p = plan_splits(lagged(spark, long_panel(16, 8)), "person", folds=2, fraction=0.25, seed=19)
    held = {r.person for r in p.frame.where(f"{OUTER} = 'test'").select("person").distinct().collect()}
    assert held == {2, 4, 8, 12}  # the first four of the permuted textual order
    texts = np.array(sorted(str(e) for e in range(16) if e not in held), dtype=object)
    order = np.random.default_rng(20).permutation(texts)
    first = {r.person for r in p.frame.where("fold_1 = 'test'").select("person").distinct().collect()}
    assert first == {int(x) for x in order[:6]}
    assert p.overlap("person").first()[OUTER] == 0


@pytest.mark.parametrize("mode", ["entity_holdout", "forward_time", "interpolation"])
@pytest.mark.parametrize("split_hash", ["permutation", "md5"])
def test_plans_do_not_leak(spark, mode, split_hash):
    frame = plan_splits(lagged(spark, long_panel(12, 18)), "person", mode, 3, 0.25, 5, split_hash).frame.toPandas()
    for name in (OUTER, *(fold_column(k) for k in (1, 2, 3))):
        among = frame if name == OUTER else frame[frame[OUTER] == "train"]
        assert among[name].notna().all() and (name == OUTER or frame[frame[OUTER] != "train"][name].isna().all())
        train, test = among[among[name] == "train"], among[among[name] == "test"]
        assert len(train) >= 2 and len(test) >= 2
        if mode == "entity_holdout":
            assert not set(train.person) & set(test.person)
        elif mode == "forward_time":
            assert train["__lead_time"].max() < test["week"].min()
        else:
            for e, own in test.groupby("person"):
                mine = train[train.person == e]
                assert not ((mine.week <= own["__lead_time"].max()) & (mine["__lead_time"] >= own.week.min())).any()
                assert len(mine)


def test_targets_never_change_a_plan(spark):
    rows = long_panel()
    other = [(e, t, x, None if t % 3 else 1e9) for e, t, x, _ in rows]
    for mode in ("entity_holdout", "forward_time", "interpolation"):
        a, b = (plan_splits(lagged(spark, r), "person", mode, 2, 0.25, 3).frame.select("person", "week", OUTER, "fold_1", "fold_2") for r in (rows, other))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_guards(spark):
    frame = lagged(spark)
    for bad in ({"mode": "other"}, {"folds": 1}, {"folds": 2.0}, {"fraction": 0.0}, {"fraction": 1.0}, {"folds": 40}, {"mode": "forward_time", "folds": 30}, {"split_hash": "x"}):
        with pytest.raises(ValueError):
            plan_splits(frame, "person", **bad)
    p = plan_splits(frame, "person", folds=2)
    assert p.usable("__target_eligible__score").count() > 0
    with pytest.raises(ValueError):
        p.usable("score")
    with pytest.raises(ValueError):
        plan_splits(frame.withColumn("__target_eligible__score", frame.week < 0), "person", folds=2).usable("__target_eligible__score")


def test_spec_round_trip(tmp_path):
    value = {
        "dataset": {"id_column": "i", "time_column": "t"}, "outcomes": ["y"], "interventions": ["a"], "environments": ["site"], "exclude": ["drop"],
        "columns": {"y": {"role": "outcome", "allowed_as_cause": False, "allowed_as_adjustment": False}, "u": {"role": "covariate", "type": "integer"}, "z": "context", "w": None},
        "adjustment": {"columns": ["u"], "rationale": "why", "include_macro": True, "estimand": "marginal"}, "metadata": {"k": 1},
    }
    spec = StudySpec.from_dict(value)
    assert StudySpec.from_dict(spec.to_dict()) == spec
    available = ["i", "t", "y", "a", "site", "drop", "u", "z", "w", "new"]
    assert spec.feature_columns(available) == ["a", "site", "u", "z", "w", "new"]
    assert spec.macro_feature_columns(available) == ["site", "u", "z", "w", "new"]
    path = tmp_path / "s.json"
    path.write_text(strict_json(value))
    assert load_spec(path) == spec
    with pytest.raises(ValueError):
        load_spec(tmp_path / "s.yaml")


@pytest.mark.parametrize("bad", [{"columns": "u", "rationale": "x"}, {"columns": ["u", "u"], "rationale": "x"}, {"columns": ["u"], "rationale": " "}, {"columns": ["u"], "rationale": "x", "include_macro": 1}, {"columns": ["u"], "rationale": "x", "estimand": "other"}, []])
def test_adjustment_is_not_coerced(bad):
    with pytest.raises(ValueError):
        AdjustmentSpec.parse(bad)


@pytest.mark.parametrize("name", ["i", "t", "y", "a", "drop", "no"])
def test_forbidden_adjustments(name):
    with pytest.raises(ValueError):
        StudySpec.from_dict({"id_column": "i", "time_column": "t", "outcomes": ["y"], "interventions": ["a"], "exclude": ["drop"], "columns": {"no": {"allowed_as_adjustment": False}}, "adjustment": {"columns": [name], "rationale": "x"}})


def test_listed_and_declared_roles():
    spec = StudySpec.from_dict({"id_column": "i", "time_column": "t", "interventions": ["a"], "columns": {"a": "context"}})
    assert spec.intervention_columns(["a"]) == ["a"] and spec.macro_feature_columns(["a"]) == ["a"]
    assert ColumnSpec.parse("x", {"role": "outcome"}).can_cause and kind_of_type("Ordinal-Numeric") == "numeric"
    with pytest.raises(ValueError):
        kind_of_type("money")


def test_csv_keeps_tokens_and_kinds(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("entity,time,site,x,z\n1,1,01,1.5,a\n1,2,1,NA,1d\n2,1,,inf,3\n")
    frame = read_panel_csv(spark, str(path))
    assert [r.site for r in frame.collect()] == ["01", "1", None]
    spec = StudySpec.from_dict({"id_column": "entity", "time_column": "time", "columns": {"site": {"type": "nominal"}}})
    from pyspark.sql import functions as F

    every = {0: F.lit(True), 1: F.col("entity") == "2"}
    assert infer_kinds(frame, ["site", "x", "z"], spec, every) == [{"site": "categorical", "x": "numeric", "z": "categorical"}, {"site": "categorical", "x": "numeric", "z": "numeric"}]


def test_sinks(tmp_path):
    with pytest.raises(ValueError):
        strict_json({"x": float("nan")})
    with JsonLines(tmp_path / "r.jsonl") as sink:
        sink.write({"a": 1})
    with pytest.raises(FileExistsError):
        JsonLines(tmp_path / "r.jsonl")


def test_what_a_spec_reads_and_writes():
    one = ColumnSpec.parse("x", {"tags": "abc", "type": None, "variable_type": "integer"})
    assert one.tags == ("abc",) and one.kind == "numeric"
    assert ColumnSpec("y").to_dict() == {"role": "unknown"} and ColumnSpec.parse("x", one.to_dict()) == one
    spec = StudySpec.from_dict({"id_column": "i", "time_column": "t", "columns": {"y": "outcome", "z": "outcome"}, "exclude": ["y"]})
    assert spec.outcome_columns(["y", "z"]) == ["z"] and "adjustment" not in spec.to_dict()
    assert AdjustmentSpec.parse({"rationale": " because "}) == AdjustmentSpec((), "because")
    with pytest.raises(ValueError, match="u is an outcome.*v is not allowed"):
        StudySpec.from_dict({"id_column": "i", "time_column": "t", "outcomes": ["u"], "columns": {"v": {"allowed_as_adjustment": False}}, "adjustment": {"columns": ["u", "v"], "rationale": "x"}})


def test_equal_months_have_one_state_in_any_order_of_rows(spark, tmp_path):
    # quantity 250 and mean tax 0.02875 lie as far from the first center as from the second: the first one holds
    taxes = [0.04, 0.01, 0.07, 0.07, 0.02, 0.0, 0.02, 0.0]
    orders = list(itertools.islice(itertools.permutations(taxes), 0, None, 97))
    assert len({functools.reduce(operator.add, o) for o in orders}) > 1
    rows = [(k, m, 31.25, 1.0, 0.0, t) for k, o in enumerate(orders) for m in ("2000-01-05", "2000-02-05") for t in o]
    frame = spark.createDataFrame(rows, "l_suppkey long, d string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    frame.selectExpr("*", "to_timestamp(d) as l_shipdate").drop("d").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in kmeans_assign(spark, str(tmp_path)).collect()] == [(0, len(orders))]


def test_exact_mean(spark):
    groups = {"tenths": [0.1] * 10, "some": [0.1, None, 0.2], "none": [None], "nan": [1.0, float("nan")], "inf": [float("inf"), 1.0], "tiny": [1e-300, 3e-300], "huge": [1e300, 1.0], "sum": [9e8] * 20, "none_left": [-0.25, 0.25]}
    frame = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    got = {r.g: r.m for r in frame.groupBy("g").agg(exact_mean("v").alias("m")).collect()}
    assert got["tenths"] == 0.1 and got["some"] == 0.15 and got["none"] is None and np.isnan(got["nan"])
    assert got["inf"] == float("inf") and got["tiny"] == 2e-300 and got["huge"] == 5e299 and got["sum"] == 9e8 and got["none_left"] == 0.0
