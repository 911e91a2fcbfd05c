"""Models and scores outside a discovery."""

import numpy as np
import pandas as pd
import pytest

from panelloom.operators.encoders import QUANTILE, Recipe
from panelloom.operators.models import cross_validated_r2, fit_linear_model, polynomial_terms, score_states, treatment_effects
from panelloom.operators.scoring import DECLARED, HELD_OUT, ROW_MODULO, PairedScores


def test_arms(spark):
    rows = [("__missing__", 1.0), (None, 2.0), ("control", 3.0), ("__missing__", 1.5), (None, 2.5), ("control", 3.5)]
    frame = spark.createDataFrame(rows, "arm string, y double")
    m = fit_linear_model(frame, ["arm"], "y")
    assert [t.name for t in m.design.terms()] == ["arm='control'", "arm=<missing>"] and m.design.levels["arm"][0] == "__missing__"
    got = {r.arm: r.p for r in frame.withColumn("p", m.prediction(frame)).collect()}
    assert np.allclose([got["__missing__"], got[None], got["control"]], [1.25, 2.25, 3.25])
    other = spark.createDataFrame([("new", 1.0), ("control", 3.0)], "arm string, y double")
    assert np.isclose(other.withColumn("p", m.prediction(other)).where("arm = 'new'").first().p, 1.25)
    assert np.isclose(m.r2(other), 1 - (0.25**2 + 0.25**2) / 2)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 2))
    y = 2 * (x[:, 0] > 0) + x[:, 1] + rng.normal(size=300)
    y[7] = np.nan
    return pd.DataFrame({"i": np.arange(300), "x": x[:, 0], "z": x[:, 1], "t": x[:, 1] * 2, "y": y})


def test_cross_validation(spark, table):
    frame = spark.createDataFrame(table).repartition(4)
    mean, scores = cross_validated_r2(frame, ["x", "z"], "y", "i", 5)
    clean = table.dropna()
    for k, s in enumerate(scores):
        a, b = clean[clean.i % 5 != k], clean[clean.i % 5 == k]
        f = lambda d: np.column_stack([np.ones(len(d)), d.x, d.z])
        beta = np.linalg.lstsq(f(a), a.y, rcond=None)[0]
        assert np.isclose(s, 1 - ((b.y - f(b) @ beta) ** 2).sum() / ((b.y - b.y.mean()) ** 2).sum())
    assert np.isclose(mean, np.mean(scores))


def test_aliased_treatment(spark, table):
    got = treatment_effects(spark.createDataFrame(table), ["t"], "y", ["z", "x"])[0]
    assert got["status"] == "non_estimable" and got["coefficient"] is None and got["uncertainty_status"] == "aliased_term"


def test_scores_by_row_modulo(spark, table):
    frame = spark.createDataFrame(table).repartition(3)
    encoder, score = score_states(frame, Recipe(0, QUANTILE, ("x",), 3), "y", "y", ["x", "z"], [], folds=3, position="i")
    clean, all_ = table.dropna(), table
    want = []
    for k in range(3):
        train_all, a, b = all_[all_.i % 3 != k], clean[clean.i % 3 != k], clean[clean.i % 3 == k]
        cuts = np.quantile(train_all.x, [1 / 3, 2 / 3])
        hot = lambda d: np.column_stack([np.ones(len(d)), *[(np.searchsorted(cuts, d.x) == s).astype(float) for s in (1, 2)]])
        beta = np.linalg.lstsq(hot(a), a.y, rcond=None)[0]
        want.append(1 - ((b.y - hot(b) @ beta) ** 2).sum() / ((b.y - b.y.mean()) ** 2).sum())
    assert np.allclose(score.paired.macro, want) and score.paired.scope == ROW_MODULO and score.row_count == 300
    merged, again = score_states(frame, Recipe(0, QUANTILE, ("x",), 3), "y", "y", ["x", "z"], [], merges=((0, 1),), folds=3, position="i")
    assert again.state_count == 2 and merged.labels == {0: 200, 2: 100} and again.macro_r2 < score.macro_r2


def test_declared_scores(spark, table):
    frame = spark.createDataFrame(table.assign(f=np.where(table.i % 2, "train", "test")))
    paired = PairedScores((0.4, 0.2), (0.1, 0.1), "elsewhere", ("a", "b"))
    recipe = Recipe(0, QUANTILE, ("x",), 2)
    _, plain = score_states(frame, recipe, "y", "y", ["x"], [], paired=paired)
    assert plain.provenance == DECLARED and plain.validation_specificity is None and plain.macro_r2 == pytest.approx(0.3)
    _, split = score_states(frame, recipe, "y", "y", ["x"], [], paired=paired, split_columns=["f"])
    assert split.to_dict()["specificity_definition"] == HELD_OUT and split.specificity > 0
    with pytest.raises(ValueError):
        score_states(frame, recipe, "y", "y", ["x"], [])


def test_polynomials(spark, table):
    out = polynomial_terms(spark.createDataFrame(table), ["x", "z"], 2)
    assert {c for c in out.columns if c.startswith("poly")} == {"poly_x_x", "poly_x_z", "poly_z_z"}
    row = out.orderBy("i").first()
    z = (table.x - table.x.mean()) / table.x.std(ddof=0)
    assert np.isclose(row.poly_x_x, z[0] ** 2)


def test_labels_and_given_splits(spark):
    import panelloom
    from panelloom.operators.models import _require_roles

    assert all(getattr(panelloom, n) is not None for n in panelloom.__all__)
    spec = panelloom.StudySpec("e", "t")
    frame = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 2.0), ("b", 1, 3.0)], "e string, t int, v double")
    labels = spark.createDataFrame([("b", 1, "q"), ("a", 1, "p"), ("a", 2, "r"), ("c", 9, "s")], "e string, t int, l string")
    assert {(r.e, r.t): r.l for r in panelloom.join_labels(frame, labels, spec, "l").collect()} == {("a", 1): "p", ("a", 2): "r", ("b", 1): "q"}
    for wrong in (labels.where("e = 'a'"), labels.unionByName(labels)):
        with pytest.raises(ValueError, match="label"):
            panelloom.join_labels(frame, wrong, spec, "l")
    roles = spark.createDataFrame([("train", "train", "train"), ("test", "test", "train"), (None, "valid", None)], "a string, b string, c string")
    _require_roles(roles, ["a"])
    for names in (["a", "b"], ["c"], ["a", "a"], ["none"]):
        with pytest.raises(ValueError, match="split"):
            _require_roles(roles, names)
