"""Encoders, selections, k-means, least squares and scores against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import scoring as sc
from panelloom.operators.encoders import COMPOSITE, KMEANS, QUANTILE, Encoder, Recipe, TopologyError, replay
from panelloom.operators.fitting import distinct_recipes, first_appearance, fit_recipes, list_recipes
from panelloom.operators.ols import fit_from_factor, held_out_r2, merge_columns
from panelloom.operators.passes import Layout, order_statistics, triangle


def rows(spark, x, y=None, roles=None, parts=3):
    n = len(x)
    data = {"__y": np.zeros(n) if y is None else y}
    roles = np.ones((n, 1), int) if roles is None else roles
    data |= {f"__r{k}": roles[:, k] for k in range(roles.shape[1])} | {f"__n{k}": x[:, k] for k in range(x.shape[1])}
    frame = spark.createDataFrame(pd.DataFrame(data)).repartition(parts)
    frame = frame.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith(("__n", "__y")) else F.col(c).cast("tinyint").alias(c) for c in frame.columns])
    return frame, Layout(roles.shape[1], tuple(f"c{k}" for k in range(x.shape[1])), ())


def lloyd(z, k):
    """K-means from evenly spaced distinct rows."""
    u = np.unique(z, axis=0)
    c = u[np.linspace(0, len(u) - 1, min(k, len(u))).round().astype(int)]
    old = None
    for _ in range(50):
        lab = ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if old is not None and (lab == old).all():
            break
        old = lab
        c = np.array([z[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(len(c))])
    lab = ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    c = c[np.unique(lab)]
    return c[np.lexsort(c.T[::-1])]


def test_order_statistics(spark):
    x = np.concatenate([np.random.default_rng(1).normal(0, 1e3, 500), [0.0, -0.0, 1e300, -1e300, 5e-324, 7, 7, 7]])
    frame, layout = rows(spark, x[:, None])
    got = order_statistics(frame, layout, lambda b: {("v",): b.numbers[:, 0]}, {("v",): [0, 1, 250, 253, 400, len(x) - 1]})
    assert got["v",] == [np.sort(x)[k] for k in (0, 1, 250, 253, 400, len(x) - 1)]


@pytest.mark.parametrize("parts", [1, 5])
def test_fits(spark, parts):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(240, 2)) * [1, 40] + [0, 5], 2)
    x[::17, 0] = np.nan
    roles = np.ones((240, 2), int)
    roles[:60, 1] = 2
    frame, layout = rows(spark, x, roles=roles, parts=parts)
    recipes = list_recipes(["c0", "c1"], 4)
    fits = fit_recipes(frame, layout, recipes)
    for s, own in ((0, x), (1, x[60:])):
        med = np.nanmedian(own, axis=0)
        filled = np.where(np.isnan(own), med, own)
        z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
        for r in recipes:
            e = fits.by[r.recipe_id, s]
            assert np.allclose(e.medians, med[[int(c[1]) for c in r.columns]], rtol=0, atol=0)
            if r.kind == QUANTILE:
                want = np.quantile(filled[:, int(r.columns[0][1])], np.arange(1, r.number) / r.number)
                assert np.allclose(e.cuts, sorted(set(want)), rtol=1e-15)
            elif r.kind == COMPOSITE:
                assert np.allclose(e.cuts, np.quantile(z.mean(axis=1), np.arange(1, r.number) / r.number))
            else:
                assert np.allclose(e.centers, lloyd(z, r.number))
            raw = e.raw(own[:, [int(c[1]) for c in r.columns]])
            assert e.occupied == tuple(np.bincount(raw, minlength=e.raw_states))
    assert [r.recipe_id for r in distinct_recipes(frame, layout, fits)][0] == 0


def test_expression_is_the_encoder(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    x[5, 0], x[6, 1] = np.nan, 0.25
    frame, _ = rows(spark, x)
    columns = [F.col("__n0"), F.col("__n1")]
    base = {"medians": (0.1, 0.2), "means": (0.0, 0.5), "scales": (1.0, 2.0)}
    for e in (
        Encoder(Recipe(0, QUANTILE, ("b",), 3), (0.25,), cuts=(-0.3, 0.25), occupied=(1, 1, 1), merges=((0, 2),)),
        Encoder(Recipe(0, COMPOSITE, ("a", "b"), 3), **base, cuts=(-0.2, 0.4)),
        Encoder(Recipe(0, KMEANS, ("a", "b"), 3), **base, centers=((-1.0, 0.0), (0.0, 0.0), (1.0, -1.0))),
    ):
        own = columns if len(e.recipe.columns) == 2 else columns[1:]
        pdf = frame.select("__n0", "__n1", e.column(own).alias("s")).toPandas()
        raw = e.raw(pdf[["__n0", "__n1"]].to_numpy()[:, -len(own) :])
        assert pdf.s.tolist() == [e.state_map[k] for k in raw.tolist()]
        assert Encoder.from_dict(e.to_dict()).to_dict()["state_map"] == e.to_dict()["state_map"]


def test_merges():
    e = Encoder(Recipe(0, QUANTILE, ("a",), 3), (0.0,), cuts=(1.0, 2.0), occupied=(4, 4, 4))
    m = e.merged(0, 2).merged(0, 1)
    assert m.state_map == {0: 0, 1: 0, 2: 0} and m.name == "q3:a|merge:0+2|merge:0+1" and m.method == "quantile_merged_merged"
    assert len(e.possible_merges()) == 3
    for bad in ((0, 0), (0, 7), (2, 9)):
        with pytest.raises(ValueError):
            e.merged(*bad)
    once = e.merged(1, 2)
    assert replay(once, e).merges == ((1, 2),)
    with pytest.raises(TopologyError) as error:
        replay(once, Encoder(e.recipe, (0.0,), cuts=(1.0,), occupied=(4, 8)))
    assert error.value.diagnostics["reason"] == "incomplete_refit_topology"
    with pytest.raises(TopologyError) as error:
        replay(Encoder(e.recipe, (0.0,), cuts=(1.0, 2.0), occupied=(4, 0, 8), merges=((0, 2),)), e)
    assert error.value.diagnostics["reason"] == "unsupported_source_topology"
    with pytest.raises(TopologyError):
        Encoder.from_dict({**once.to_dict(), "state_map": {"0": 0, "1": 1, "2": 2}})


def test_canonical_labels(spark):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate("bbacab")], "i long, label string")
    assert [r.canonical for r in first_appearance(frame, "label", "i").orderBy("i").collect()] == [0, 0, 1, 2, 1, 0]


def factor(x, y):
    return triangle(np.column_stack([np.ones(len(y)), x, y]))


def test_least_squares():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1, 1e6, 1e-6]
    y = x @ [1.0, 2e-6, 3e6] + rng.normal(size=200) + 5
    fit = fit_from_factor(factor(x, y), 200, ("i", "a", "b", "c"))
    full = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(full / np.linalg.norm(full, axis=0), y, rcond=None)[0] / np.linalg.norm(full, axis=0)
    assert np.allclose(fit.beta, beta, rtol=1e-9)
    rest = y - full @ beta
    cov = np.linalg.inv(full.T @ full) * (rest @ rest) / 196
    assert np.allclose(fit.stderr, np.sqrt(np.diag(cov)), rtol=1e-6)
    assert np.isclose(fit.r2, 1 - rest @ rest / ((y - y.mean()) ** 2).sum())
    x2, y2 = rng.normal(size=(50, 3)) * [1, 1e6, 1e-6], rng.normal(size=50)
    want = 1 - ((y2 - np.column_stack([np.ones(50), x2]) @ beta) ** 2).sum() / ((y2 - y2.mean()) ** 2).sum()
    assert np.isclose(held_out_r2(fit, factor(x2, y2), 50, y2.min(), y2.max()), want, rtol=1e-9)


def test_aliases_and_edges():
    rng = np.random.default_rng(5)
    t = rng.normal(size=300)
    fit = fit_from_factor(factor(np.column_stack([t, t]), 2 * t + rng.normal(size=300)), 300, ("i", "t", "u"))
    assert fit.rank == 2 and fit.aliased == ["t", "u"] and fit.condition is None and np.isnan(fit.coefficients[1])
    assert np.isclose(fit.beta[1], fit.beta[2])  # minimum norm
    exact = fit_from_factor(factor(np.array([[1.0], [2.0]]), np.array([1.0, 3.0])), 2, ("i", "x"))
    assert exact.residual_df == 0 and np.isnan(exact.stderr).all()
    assert fit_from_factor(factor(t[:, None], np.full(300, 3.0)), 300, ("i", "t")).r2 == 0.0
    with pytest.raises(ValueError):
        fit_from_factor(factor(t[:1, None], t[:1]), 1, ("i", "t"))
    with pytest.raises(ValueError):
        held_out_r2(fit, factor(np.column_stack([t, t]), t), 300, 1.0, 1.0)


def test_merged_factor_is_the_merged_design():
    rng = np.random.default_rng(6)
    raw, a, y = rng.integers(0, 4, 120), rng.normal(size=120), rng.normal(size=120)
    hot = (raw[:, None] == np.arange(4)).astype(float)
    r = triangle(np.column_stack([np.ones(120), a, hot, y]))
    small = merge_columns(r, 2, [[1], [2, 3]])
    direct = np.column_stack([np.ones(120), a, hot[:, 1], hot[:, 2] + hot[:, 3]])
    fit = fit_from_factor(small, 120, ("i", "a", "s1", "s2"))
    assert np.allclose(fit.beta, np.linalg.lstsq(direct, y, rcond=None)[0])


def test_scores():
    assert sc.fold_stability([0.3]) == 0 and sc.fold_stability([0.1, 0.3]) == pytest.approx(1 / 1.1)
    assert sc.compression_score(1, 100) == 0 and sc.compression_score(2, 4) == 0.5 and sc.compression_score(9, 2) == 0
    assert sc.variance_share(np.array([2.0, 2.0]), np.array([0.0, 1.0]), 0.25) == 1.0
    assert sc.variance_share(np.array([1.0]), np.array([0.0]), 1.0) == 0.0
    p = sc.PairedScores((0.5, 0.3), (0.2, 0.4), "s", ("a", "b"))
    m = sc.MacroScore("m", "y", "t", p, sc.COMPUTED, 0.4, 0.2, 2, 16)
    assert m.ranking_score == pytest.approx(0.45 * 0.4 + 0.25 * 0.4 + 0.2 / 1.1 + 0.1 * 0.75)
    assert m.to_dict()["emergence_evidence_status"] == "not_assessed" and m.to_dict()["specificity"] == 0.4
    assert sc.MacroScore("m", "y", "t", p, sc.DECLARED, None, 0.2, 2, 16).to_dict()["specificity_definition"] == sc.DESCRIPTIVE
    for bad in (((), ()), ((1.0,), (1.0, 2.0)), ((float("nan"),), (0.0,))):
        with pytest.raises(ValueError):
            sc.PairedScores(*bad, "s")
    with pytest.raises(ValueError):
        sc.PairedScores((1.0, 2.0), (1.0, 2.0), "s", ("a", "a"))
    with pytest.raises(ValueError):
        sc.MacroScore("m", "y", "t", p, sc.COMPUTED, 0.4, 0.2, 20, 16)
