"""Whole plans on panels with known mechanisms."""

import json

import numpy as np
import pandas as pd
import pytest

from panelloom.cli import main
from panelloom.operators.adjustment import JointFactor, effect_estimates, treatment_records
from panelloom.operators.encoders import Encoder, Recipe
from panelloom.operators.ols import Design
from panelloom.operators.passes import triangle
from panelloom.operators.scoring import MacroScore, PairedScores, ScoreTopologyError
from panelloom.operators.search import search
from panelloom.plans import study
from panelloom.plans.discovery import DiscoveryConfig, discover
from panelloom.plans.spec import StudySpec
from panelloom.sources.generators import CASES, generate
from panelloom.sources.tables import strict_json

SMALL = {"max_states": 3, "paths": 2, "folds": 3, "holdout_fraction": 0.25, "seed": 17}


def rounded(value):
    """Sums over partitions differ in their last digits."""
    if isinstance(value, dict):
        return {k: rounded(v) for k, v in value.items() if k not in ("rank_tolerance", "condition_number")}
    if isinstance(value, list):
        return [rounded(v) for v in value]
    return float(f"{value:.7g}") + 0.0 if isinstance(value, float) and abs(value) > 1e-9 else 0.0 if isinstance(value, float) else value


def naive_score(pdf, labels, target, treatments, micro, folds):
    """Macro, micro and state R2 by fold, straight from rows; labels(train) gives a function of a frame."""
    out = []
    for train, test in folds:
        label = labels(train)
        a, b = label(train), label(test)
        levels = sorted(set(a), key=str)[1:]
        hot = lambda s: np.stack([(s == v).astype(float) for v in levels], axis=1) if levels else np.zeros((len(s), 0))
        x = lambda f, cols, s=None: np.column_stack([np.ones(len(f)), f[cols].to_numpy(float), *([hot(s)] if s is not None else [])])
        y, z = train[target].to_numpy(), test[target].to_numpy()
        row = []
        for p, q in ((x(train, treatments, a), x(test, treatments, b)), (x(train, micro), x(test, micro)), (x(train, [], a), x(test, [], b))):
            beta = np.linalg.lstsq(p, y, rcond=None)[0]
            row.append(1 - ((z - q @ beta) ** 2).sum() / ((z - z.mean()) ** 2).sum())
        out.append(row)
    return np.array(out)


@pytest.fixture(scope="module")
def confounded(spark):
    panel = generate("known_confounding", 40, 12, 5)
    return panel, discover(panel.frame(spark), panel.spec, DiscoveryConfig(**SMALL))


def test_known_confounding(confounded):
    _, d = confounded
    strict_json(d)
    best = d["top_macros"][0]
    assert best["macro_name"].startswith("q3:u")
    assert abs(d["candidate_pathways"][0]["coefficient"] - 1.5) < 0.35
    changes = d["adjustment"]["comparison"]["coefficient_changes"][0]
    assert changes["macro_only_coefficient"] > 2.5  # the coarse state leaves confounding
    assert d["adjustment"]["declared_covariate_diagnostics"]["coarsened_by_macro"][0]["column"] == "u"
    assert d["outer_evaluation"]["status"] == "evaluated" and 0.8 < d["outer_evaluation"]["macro_r2"] < d["outer_evaluation"]["micro_r2"]
    scores = [r["ranking_score"] for r in d["top_macros"]]
    assert scores == sorted(scores, reverse=True)


def test_scores_match_rows(spark, confounded):
    """The factorised scores of the winner against fits on the rows themselves."""
    from panelloom.operators.panel import build_lagged
    from panelloom.operators.splits import plan_splits

    panel, d = confounded
    lagged = build_lagged(panel.frame(spark), panel.spec).frame
    pdf = plan_splits(lagged, "entity_id", "entity_holdout", 3, 0.25, 17).frame.toPandas()
    dev, held = pdf[pdf.outer_role == "train"], pdf[pdf.outer_role == "test"]
    best = d["top_macros"][0]
    assert "merge" not in best["macro_name"]
    column = best["macro_name"].split(":")[1]
    bins = int(best["macro_name"][1])

    def labels(train):
        cuts = np.quantile(train[column], np.arange(1, bins) / bins)
        return lambda f: np.searchsorted(cuts, f[column], side="left")

    micro = ["x1", "x2", "x3", "u", "treatment"]
    folds = [(dev[dev[f"fold_{k}"] == "train"], dev[dev[f"fold_{k}"] == "test"]) for k in (1, 2, 3)]
    want = naive_score(pdf, labels, "y__lead1", ["treatment"], micro, folds)
    assert np.allclose(best["macro_fold_scores"], want[:, 0], atol=1e-9)
    assert np.allclose(best["micro_fold_scores"], want[:, 1], atol=1e-9)
    assert np.isclose(best["specificity"], np.maximum(want[:, 2], 0).mean(), atol=1e-9)
    outer = naive_score(pdf, labels, "y__lead1", ["treatment"], micro, [(dev, held)])[0]
    assert np.isclose(d["outer_evaluation"]["macro_r2"], outer[0], atol=1e-9) and np.isclose(d["outer_evaluation"]["micro_r2"], outer[1], atol=1e-9)
    state = labels(dev)(dev)
    y = dev["y__lead1"].to_numpy()
    eta = sum((state == s).sum() * (y[state == s].mean() - y.mean()) ** 2 for s in set(state)) / len(y) / y.var()
    assert np.isclose(best["outcome_specificity"], eta, atol=1e-9)


@pytest.mark.parametrize("mode", ["entity_holdout", "forward_time", "interpolation"])
def test_holdout_targets_change_nothing_before_the_evaluation(spark, mode):
    panel = generate("additive_signal", 20, 12, 3)
    config = DiscoveryConfig(**SMALL | {"max_states": 2, "paths": 1, "folds": 2}, validation_mode=mode)
    from panelloom.operators.panel import build_lagged
    from panelloom.operators.splits import plan_splits

    pdf = panel.frame(spark).toPandas()
    plan = plan_splits(build_lagged(panel.frame(spark), panel.spec).frame, "entity_id", mode, 2, 0.25, 17).frame
    held = {(r.entity_id, r.time + 1) for r in plan.where("outer_role = 'test'").collect()}
    poisoned = pdf.copy()
    at = [i for i, r in enumerate(zip(pdf.entity_id, pdf.time)) if r in held]
    poisoned.loc[at, "y"] = 1e6 + np.arange(len(at))
    a, b = (discover(spark.createDataFrame(f), panel.spec, config) for f in (pdf, poisoned))
    for part in ("top_macros", "searches", "adjustment"):
        assert rounded(a[part]) == rounded(b[part])
    assert a["outer_evaluation"]["macro_r2"] != b["outer_evaluation"]["macro_r2"]


def test_constant_holdout_is_a_result(spark):
    panel = generate("additive_signal", 16, 10, 4)
    config = DiscoveryConfig(**SMALL | {"max_states": 2, "paths": 1, "folds": 2}, validation_mode="forward_time")
    pdf = panel.frame(spark).toPandas()
    pdf.loc[pdf.time >= 7, "y"] = 1.0
    d = discover(spark.createDataFrame(pdf), panel.spec, config)
    assert d["outer_evaluation"]["status"] == "not_evaluable" and "constant" in d["outer_evaluation"]["reason"]
    pdf.loc[(pdf.time > 1) & (pdf.time < 8), "y"] = 2.0
    with pytest.raises(ValueError):
        discover(spark.createDataFrame(pdf), panel.spec, config)


def test_guards(spark):
    panel = generate("iid_null", 6, 6, 1)
    frame = panel.frame(spark)
    for bad in ({"top_k": 0}, {"max_states": 1}, {"outcome": "none"}):
        with pytest.raises(ValueError):
            discover(frame, panel.spec, DiscoveryConfig(**bad))
    spec = StudySpec.from_dict({"id_column": "entity_id", "time_column": "time", "outcomes": ["y"], "exclude": ["x1", "x2", "x3"], "columns": {"y": {"role": "outcome", "allowed_as_cause": False, "allowed_as_adjustment": False}}})
    with pytest.raises(ValueError, match="macro state"):
        discover(frame, spec, DiscoveryConfig(**SMALL))


def test_search_by_hand():
    start = Encoder(Recipe(0, "quantile", ("a",), 3), (0.0,), cuts=(0.0, 1.0), occupied=(5, 5, 5))
    value = {"q3:a": 0.1, "q3:a|merge:0+1": 0.3, "q3:a|merge:0+2": None, "q3:a|merge:1+2": 0.2}

    def score(e):
        if value[e.name] is None:
            raise ScoreTopologyError(e.name, [{"fold_index": 0, "topology": {}}])
        v = value[e.name]
        return MacroScore(e.name, "y", "t", PairedScores((v, v), (0.0, 0.0), "s"), "computed_training_only_refit", 0.0, 0.0, len(e.labels), 15)

    got = search(start, score, 2, 1)
    assert got.best.encoder.name == "q3:a|merge:0+1" and got.status == "partial_topology_rejections"
    assert len(got.sampled) == 3 and len(got.rejected) == 1 and len(got.paths) == 1 and len(got.paths[0]) == 2
    value["q3:a"] = None
    assert search(start, score).status == "no_valid_candidate"
    with pytest.raises(ValueError):
        search(start, score, 0)


def test_treatments():
    rng = np.random.default_rng(8)
    n = 5000
    u, w = rng.normal(size=n), rng.normal(size=n)
    a, b = u + w + 0.5 * rng.normal(size=n), u - 0.5 * w + 0.5 * rng.normal(size=n)
    arm = rng.integers(0, 3, n)
    y = 1.7 * a - 0.9 * b + 1.2 * u + 0.5 * (arm == 2) + rng.normal(size=n)
    x = np.column_stack([np.ones(n), a, b, u, arm == 1, arm == 2, y]).astype(float)
    design = Design(("a", "b", "u", "arm"), ("numeric",) * 3 + ("categorical",), {}, {"arm": ("k", "l", None)})
    f = JointFactor(triangle(x), n, design)
    joint = {r["intervention"]: r for r in treatment_records(f, ["a", "b", "arm"], "y", ["u"])}
    assert abs(joint["a"]["coefficient"] - 1.7) < 0.06 and abs(joint["b"]["coefficient"] + 0.9) < 0.06
    assert [t["feature_name"] for t in joint["arm"]["terms"]] == ["arm='l'", "arm=<missing>"] and joint["arm"]["status"] == "categorical"
    assert abs(joint["arm"]["terms"][1]["coefficient"] - 0.5) < 0.15
    marginal = treatment_records(f, ["a", "b"], "y", ["u"], "marginal")
    assert abs(marginal[0]["coefficient"] - 1.7) > 0.3
    assert effect_estimates(list(joint.values()))[0]["intervention"] == "a"
    with pytest.raises(ValueError):
        treatment_records(f, ["a"], "y", ["a"])


def test_generators_and_intervals(spark, tmp_path):
    for case in CASES:
        p = generate(case, 8, 6, 1)
        assert len(p.columns["y"]) == 48 and (generate(case, 8, 6, 1).columns["y"] == p.columns["y"]).all()
    assert study.t_critical(1) == pytest.approx(12.706204736, rel=1e-9) and study.t_critical(26) == pytest.approx(2.055529439, rel=1e-9) and abs(study.t_critical(60) - 2.0003) < 2e-3
    low, high = study.wilson_interval(31, 32)
    assert round(low, 4) == 0.8426 and round(high, 4) == 0.9945
    assert study.mean_interval([1.0, 2.0, 3.0])["t_interval"][0] == pytest.approx(2 - 4.30265273 / 3**0.5)
    profile = study.Profile(cells=(("iid_null", "entity_holdout"), ("additive_signal", "entity_holdout")), panels=2)
    good = lambda s, r2: {"case": "iid_null", "split": "entity_holdout", "seed": s, "status": "success", "compression": 0.5, "selected_family": "q2", "oracle_r2": None, "thin_states": [], "paired_r2": r2}
    r2 = dict(zip(study.COMPARATORS, (0.1, 0.2, -0.05, None, 0.25, 0.1), strict=True))
    a, b = profile.seeds(0)
    c, d = profile.seeds(1)
    bad = [{"case": "additive_signal", "split": "entity_holdout", "seed": s, "status": "failed", "failure_reason": "x"} for s in (c, d)]
    records = [good(a, r2), good(b, r2 | {"selected_macro": 0.3}), *bad]
    (tmp_path / "trials.jsonl").write_text("".join(strict_json(r) + "\n" for r in records))
    audit = study.export_study(spark, str(tmp_path / "trials.jsonl"), str(tmp_path / "out"), profile)
    assert audit["passed"] and audit["planned_trials"] == 4 and audit["failed_trials"] == 2
    table = pd.read_csv(tmp_path / "out" / "results.csv").set_index("case")
    assert table.loc["additive_signal", "failures"] == 2 and np.isnan(table.loc["additive_signal", "selected_macro"])
    null = table.loc["iid_null"]
    assert null.minus_restricted_micro == pytest.approx(0.0) and null.minus_restricted_micro_positive == 1 and null.prespecified_macro_n == 0 and null.families == "q2:2"
    assert null.selected_macro_mc_se == pytest.approx(0.1) and "iid_null" in (tmp_path / "out" / "RESULTS.md").read_text()
    rows = [("iid_null", "entity_holdout", s, "success", 0.5, "q2", None, [], tuple(r2.values())) for s in (a, b)]
    frame = spark.createDataFrame(rows, study.TRIAL)
    summary = [r.asDict() for r in study.summarize_trials(spark, frame, profile).collect()]
    with pytest.raises(ValueError, match="twice"):
        study.summarize_trials(spark, frame.unionByName(frame), profile)
    with pytest.raises(ValueError, match="records"):
        study.audit_trials(records, summary, profile)
    with pytest.raises(ValueError, match="planned trials"):
        study.audit_trials(records[1:], summary, profile)


def test_rare_states_lie_in_the_holdout(spark):
    from panelloom.operators.panel import build_lagged
    from panelloom.operators.splits import plan_splits

    p = generate("rare_absent_states", 12, 10, 3)
    frame = build_lagged(p.frame(spark), p.spec).frame
    plan = plan_splits(frame, "entity_id", "entity_holdout", 2, 0.25, 17, "permutation")
    assert [r[0] for r in plan.frame.where("rare_entity_state = 1").select("outer_role").distinct().collect()] == ["test"]
    assert frame.where("rare_tail_state = 1").count() == 1


@pytest.mark.parametrize("case", ["known_confounding", "nonlinear_threshold"])
def test_trial(spark, case):
    config = DiscoveryConfig(max_states=2, paths=1, folds=2, holdout_fraction=0.25, seed=17)
    r = study.run_trial(spark, case, "entity_holdout", 5, study.Profile(entities=24, periods=8, draws=20, config=config))
    assert r["status"] == "success", r
    r2 = r["paired_r2"]
    assert set(r2) == set(study.COMPARATORS) and r2["matched_micro"] == pytest.approx(r2["selected_macro"], abs=1e-9) and r2["no_macro"] < 0.05
    p = generate(case, 24, 8, 5)
    frame = pd.DataFrame(p.columns | {"label": p.labels}).sort_values(["entity_id", "time"])
    frame["next"] = frame.groupby("entity_id")["y"].shift(-1)
    frame = frame.dropna()
    held = set(np.random.default_rng(17).permutation(np.array(sorted(set(frame.entity_id)), dtype=object))[:6])
    test = frame.entity_id.isin(held).to_numpy()

    def plain(*columns):
        x = np.column_stack([np.ones(len(frame)), *[frame[c] if isinstance(c, str) else c for c in columns]]).astype(float)
        y = frame.next.to_numpy()
        e = y[test] - x[test] @ np.linalg.lstsq(x[~test], y[~test], rcond=None)[0]
        return 1 - (e**2).sum() / ((y[test] - y[test].mean()) ** 2).sum()

    raw = ["treatment"] if case == "known_confounding" else []
    assert r2["prespecified_macro"] == pytest.approx(plain(*raw, "label")) and r2["no_macro"] == pytest.approx(plain())
    if case == "known_confounding":
        x = np.column_stack([np.ones((~test).sum()), frame.treatment[~test], frame.u[~test]])
        both = np.linalg.lstsq(x, frame.next[~test], rcond=None)[0]
        assert r["confounding"]["joint_raw_confounder"]["treatment"] == pytest.approx(both[1])
        assert r["confounding"]["marginal"]["treatment"] == pytest.approx(np.linalg.lstsq(x[:, :2], frame.next[~test], rcond=None)[0][1])
        assert r["cluster_bootstrap"]["low"] < r["cluster_bootstrap"]["high"] and set(r["confounding"]["coarse_macro_adjusted"]) == {"treatment"}
    else:
        assert r["oracle_r2"] == pytest.approx(plain("oracle_threshold"))


def test_bootstrap(spark):
    panel = generate("known_confounding", 60, 8, 9)
    from panelloom.operators.panel import build_lagged

    frame = build_lagged(panel.frame(spark), panel.spec).frame
    low, high, used = study.cluster_bootstrap_interval(frame, "entity_id", "y__lead1", "treatment", ["u"], draws=100)
    assert used == 100 and low < 1.55 and high > 1.45 and high - low < 1.0


def test_stream(spark, tmp_path):
    from panelloom.streaming.states import state_counts, with_state

    e = Encoder(Recipe(0, "quantile", ("value",), 2), (0.5,), cuts=(0.5,), occupied=(1, 1))
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value", "ts")
    source = source.withColumn("ts", source.ts.cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for frame, mode, name in ((with_state(stream, e), "append", "rows"), (state_counts(stream, e, "ts"), "complete", "counts")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("rows").exceptAll(with_state(source, e)).count() == 0
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == source.count()


def test_command_line(tmp_path, capsys, spark):
    panel = generate("nonlinear_threshold", 20, 8, 2)
    pd.DataFrame(panel.columns).drop(columns=["oracle_threshold"]).to_csv(tmp_path / "p.csv", index=False)
    (tmp_path / "s.json").write_text(strict_json(panel.spec.to_dict()))
    assert main(["validate", str(tmp_path / "p.csv"), str(tmp_path / "s.json"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["entity_count"] == 20
    args = ["discover", str(tmp_path / "p.csv"), str(tmp_path / "s.json"), "--max-states", "2", "--paths", "1", "--folds", "2", "--output", str(tmp_path / "o.json")]
    assert main(args) == 0
    assert "Holdout" in capsys.readouterr().out and json.loads((tmp_path / "o.json").read_text())["top_macros"]
    assert main(["validate", str(tmp_path / "p.csv"), str(tmp_path / "none.json")]) == 2
    assert main(["discover", str(tmp_path / "p.csv"), str(tmp_path / "s.json"), "--outcome", "zz"]) == 2


def test_entry_without_the_corpus_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "next_value_by_state" in names and set(entry.oracle_sql()) <= set(names)
