"""Fits all recipes on all splits together.

Split 0 trains on all development rows, split k on the training rows of inner fold k. Each statistic is one pass (or one
exact selection) for all splits and columns at once; k-means models of all splits advance in the same passes.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.encoders import COMPOSITE, KMEANS, QUANTILE, Encoder, Fits, Recipe, nearest
from panelloom.operators.passes import Batch, Layout, Parts, interpolate, order_statistics, quantile_ranks, run_pass


def list_recipes(numeric: list[str], max_states: int) -> list[Recipe]:
    """Terciles and halves of each column and of their composite, and k-means of up to max_states states."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    for c in numeric:
        out += [(QUANTILE, (c,), b) for b in (2, 3) if b <= max_states]
    if len(numeric) >= 2:
        out += [(COMPOSITE, tuple(numeric), b) for b in (2, 3) if b <= max_states]
        out += [(KMEANS, tuple(numeric), k) for k in range(2, max_states + 1)]
    elif numeric:
        out += [(KMEANS, tuple(numeric), k) for k in range(2, max_states + 1)]
    return [Recipe(k, *x) for k, x in enumerate(out)]


def medians(frame: DataFrame, layout: Layout, finite_target: bool) -> tuple[np.ndarray, np.ndarray]:
    """Medians (NaN where there is no value) and counts of finite values: splits x numeric columns, over training rows."""
    splits, p = layout.splits, len(layout.numeric)

    def values(batch: Batch) -> dict[tuple, np.ndarray]:
        out = {}
        for s in range(splits):
            rows = batch.roles[:, s] == 1
            if finite_target:
                rows &= np.isfinite(batch.y)
            for j in range(p):
                x = batch.numbers[rows, j]
                out[s, j] = x[np.isfinite(x)]
        return out

    counts = run_pass(frame, layout, lambda b: {("sum", k): np.array([len(v)]) for k, v in values(b).items()})
    n = np.zeros((splits, p), np.int64)
    for (_, (s, j)), v in counts.items():
        n[s, j] = v[0]
    wanted = {(s, j): [(n[s, j] - 1) // 2, n[s, j] // 2] for s in range(splits) for j in range(p) if n[s, j]}
    found = order_statistics(frame, layout, values, {k: [int(x) for x in v] for k, v in wanted.items()})
    out = np.full((splits, p), np.nan)
    for (s, j), (a, b) in found.items():
        out[s, j] = a if a == b else (a + b) / 2
    return out, n


def fit_recipes(frame: DataFrame, layout: Layout, recipes: list[Recipe], max_iter: int = 50) -> Fits:
    """Encoders of all recipes on the training rows of all splits."""
    splits = layout.splits
    index = {c: j for j, c in enumerate(layout.numeric)}
    used = sorted({index[c] for r in recipes for c in r.columns})
    middle, counts = medians(frame, layout, finite_target=False)
    for j in used:
        if (counts[:, j] == 0).any():
            raise ValueError(f"feature {layout.numeric[j]!r} has no finite value in a training split")

    def filled(batch: Batch, s: int) -> np.ndarray:
        x = batch.numbers[batch.roles[:, s] == 1]
        return np.where(np.isfinite(x), x, middle[s])

    sizes = run_pass(frame, layout, lambda b: {("sum", s): np.concatenate([[(b.roles[:, s] == 1).sum()], filled(b, s).sum(axis=0)]) for s in range(splits)})
    n = {s: int(sizes["sum", s][0]) for s in range(splits)}
    mean = np.stack([sizes["sum", s][1:] / max(n[s], 1) for s in range(splits)])
    spread = run_pass(frame, layout, lambda b: {("sum", s): ((filled(b, s) - mean[s]) ** 2).sum(axis=0) for s in range(splits)})
    scale = np.sqrt(np.stack([spread["sum", s] / max(n[s], 1) for s in range(splits)]))
    scale[~(scale > 0)] = 1.0
    composite = next((r for r in recipes if r.kind == COMPOSITE), None)
    chosen = [index[c] for c in composite.columns] if composite else []
    binned = sorted({index[r.columns[0]] for r in recipes if r.kind == QUANTILE})

    def values(batch: Batch) -> dict[tuple, np.ndarray]:
        out = {}
        for s in range(splits):
            x = filled(batch, s)
            out |= {(s, j): x[:, j] for j in binned}
            if chosen:
                out[s, "composite"] = ((x - mean[s]) / scale[s])[:, chosen].mean(axis=1)
        return out

    bins = sorted({r.number for r in recipes if r.kind != KMEANS})
    shares = [i / b for b in bins for i in range(1, b)]
    wanted = {(s, j): quantile_ranks(n[s], shares) for s in range(splits) for j in [*binned, *(["composite"] if chosen else [])]}
    ordered = order_statistics(frame, layout, values, wanted) if shares else {}
    out = Fits(recipes)
    for r in recipes:
        at = [index[c] for c in r.columns]
        for s in range(splits):
            base = Encoder(r, tuple(middle[s, at].tolist()))
            if r.kind != QUANTILE:
                base = replace(base, means=tuple(mean[s, at].tolist()), scales=tuple(scale[s, at].tolist()))
            if r.kind != KMEANS:
                key = (s, at[0] if r.kind == QUANTILE else "composite")
                cuts = dict(zip([(b, i) for b in bins for i in range(1, b)], interpolate(n[s], shares, ordered[key]), strict=True))
                base = replace(base, cuts=tuple(sorted({cuts[r.number, i] for i in range(1, r.number)})))
            out.by[r.recipe_id, s] = base
    _fit_kmeans(frame, layout, out, max_iter)
    return _occupied(frame, layout, out)


def _fit_kmeans(frame: DataFrame, layout: Layout, fits: Fits, max_iter: int) -> None:
    """Lloyd's algorithm for all k-means recipes and splits at once, from centers that the data's order fixes."""
    recipes = [r for r in fits.recipes if r.kind == KMEANS]
    if not recipes:
        return
    columns = [layout.numeric.index(c) for c in recipes[0].columns]
    starts = _initial_centers(frame, layout, fits, recipes, columns)
    models = {(r.recipe_id, s): starts[r.recipe_id, s] for r in recipes for s in range(layout.splits)}
    before: dict[tuple, np.ndarray | None] = dict.fromkeys(models)
    open_ = {k for k, c in models.items() if len(c) > 1}

    def z_of(batch: Batch, s: int) -> np.ndarray:
        e = fits.by[recipes[0].recipe_id, s]
        x = batch.numbers[batch.roles[:, s] == 1][:, columns]
        return (np.where(np.isfinite(x), x, np.array(e.medians)) - np.array(e.means)) / np.array(e.scales)

    for _ in range(max_iter):
        if not open_:
            break
        now = {k: (models[k], before[k]) for k in open_}

        def step(batch: Batch, now=now) -> Parts:
            out: Parts = {}
            points = {s: z_of(batch, s) for s in {s for _, s in now}}
            for (r, s), (centers, old) in now.items():
                z = points[s]
                label = nearest(z, centers)
                changed = np.ones(1) if old is None else np.array([float((label != nearest(z, old)).sum())])
                sums = np.zeros((len(centers), z.shape[1] + 1))
                np.add.at(sums, label, np.column_stack([z, np.ones(len(z))]))
                out["sum", r, s] = np.concatenate([sums.ravel(), changed])
            return out

        for (_, r, s), v in run_pass(frame, layout, step).items():
            centers = models[r, s]
            sums, changed = v[:-1].reshape(len(centers), -1), v[-1]
            if before[r, s] is not None and changed == 0:
                open_.discard((r, s))
                continue
            before[r, s] = centers
            has = sums[:, -1] > 0
            updated = centers.copy()
            updated[has] = sums[has, :-1] / sums[has, -1:]
            models[r, s] = updated

    def label(batch: Batch) -> Parts:
        points = {s: z_of(batch, s) for s in range(layout.splits)}
        return {("sum", r, s): np.bincount(nearest(points[s], c), minlength=len(c)) for (r, s), c in models.items()}

    for (_, r, s), rows in run_pass(frame, layout, label).items():
        centers = models[r, s][rows > 0]
        order = np.lexsort(tuple(centers[:, j] for j in range(centers.shape[1] - 1, -1, -1)))
        fits.by[r, s] = replace(fits.by[r, s], centers=tuple(map(tuple, centers[order].tolist())))


def _initial_centers(frame: DataFrame, layout: Layout, fits: Fits, recipes: list[Recipe], columns: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """Distinct standardised rows at evenly spaced places of their lexicographic order, by recipe and split."""
    spark = frame.sparkSession
    names = [f"z{j}" for j in range(len(columns))]
    rows = None
    for s in range(layout.splits):
        e = fits.by[recipes[0].recipe_id, s]
        z = [((F.coalesce(F.col(f"__n{c}"), F.lit(m)) - F.lit(a)) / F.lit(d)).alias(n) for c, m, a, d, n in zip(columns, e.medians, e.means, e.scales, names, strict=True)]
        own = frame.where(F.col(f"__r{s}") == 1).select(F.lit(s).alias("s"), *z).distinct()
        rows = own if rows is None else rows.unionByName(own)
    from panelloom.operators.ranks import with_rank
    from panelloom.runtime import temporary_scratch

    out: dict[tuple[int, int], np.ndarray] = {}
    with temporary_scratch(spark, "centers") as scratch:
        ranked = with_rank(rows, ["s", *names], scratch)
        bounds = {r["s"]: (r["a"], r["n"]) for r in ranked.groupBy("s").agg(F.min("rank").alias("a"), F.count("*").alias("n")).collect()}
        places = {}
        for r in recipes:
            for s, (first, n) in bounds.items():
                k = min(r.number, n)
                at = np.linspace(0, n - 1, k).round().astype(int) if k > 1 else np.array([0])
                places[r.recipe_id, s] = [int(first + x) for x in at]
        wanted = sorted({x for v in places.values() for x in v})
        found = {r["rank"]: [r[n] for n in names] for r in ranked.where(F.col("rank").isin(wanted)).collect()}
    for key, at in places.items():
        out[key] = np.array([found[x] for x in at])
    return out


def _occupied(frame: DataFrame, layout: Layout, fits: Fits) -> Fits:
    """Fill in how many training rows each raw state has."""
    index = {c: j for j, c in enumerate(layout.numeric)}
    encoders = dict(fits.by)

    def count(batch: Batch) -> Parts:
        out: Parts = {}
        for (r, s), e in encoders.items():
            rows = batch.numbers[batch.roles[:, s] == 1][:, [index[c] for c in e.recipe.columns]]
            out["sum", r, s] = np.bincount(e.raw(rows), minlength=e.raw_states)
        return out

    for (_, r, s), rows in run_pass(frame, layout, count).items():
        fits.by[r, s] = replace(fits.by[r, s], occupied=tuple(int(x) for x in rows))
    return fits


def distinct_recipes(frame: DataFrame, layout: Layout, fits: Fits) -> list[Recipe]:
    """Recipes with two states or more whose labels differ from those of all recipes before them."""
    index = {c: j for j, c in enumerate(layout.numeric)}
    kept = [r for r in fits.recipes if len(fits.by[r.recipe_id, 0].occupied_raw) > 1]
    encoders = [fits.by[r.recipe_id, 0] for r in kept]

    def differ(batch: Batch) -> Parts:
        rows = batch.numbers[batch.roles[:, 0] == 1]
        labels = [e.raw(rows[:, [index[c] for c in e.recipe.columns]]) for e in encoders]
        return {("max", "differ"): np.array([[float((a != b).any()) for b in labels] for a in labels])}

    if not kept:
        return []
    differs = run_pass(frame, layout, differ)["max", "differ"]
    out: list[int] = []
    for i in range(len(kept)):
        if all(differs[i, j] for j in out):
            out.append(i)
    return [kept[i] for i in out]


def first_appearance(frame: DataFrame, label: str, order: str) -> DataFrame:
    """Labels renumbered by where they first appear in the order of a column: adds `canonical`."""
    first = frame.groupBy(label).agg(F.min(order).alias("__first"))
    ranks = first.select(label, (F.dense_rank().over(Window.orderBy("__first")) - 1).alias("canonical"))
    return frame.join(ranks, frame[label].eqNullSafe(ranks[label])).drop(ranks[label])
