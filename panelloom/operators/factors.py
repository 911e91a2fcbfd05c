"""Everything that scoring needs from the rows, in one pass: triangular factors per recipe, split and side."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.encoders import Encoder, Fits, Recipe, TopologyError, replay, topology
from panelloom.operators.fitting import medians
from panelloom.operators.ols import Design, Fit, fit_from_factor, held_out_r2, merge_columns, sorted_levels
from panelloom.operators.passes import Batch, Layout, Parts, add, run_pass, triangle
from panelloom.operators.scoring import COMPUTED, GIVEN_SPLITS, MacroScore, PairedScores, ScoreTopologyError, variance_share

TRAIN, TEST = 1, 2
#: Levels of all categorical columns and splits that factors may have.
MOST_LEVELS = 20_000


def fit_designs(frame: DataFrame, layout: Layout, columns: list[str], kinds: list[dict[str, str]], most_levels: int = MOST_LEVELS) -> list[Design]:
    """Design encoders of the training rows with a target, by split. kinds: column -> kind, by split. Each level is a column
    of the factors: more than `most_levels` over all splits are an error, and never come to the driver."""
    fills, _ = medians(frame, layout, finite_target=True)
    numeric = {c: j for j, c in enumerate(layout.numeric)}
    levels: dict[tuple[str, int], list] = {}
    pairs = None
    for j, c in enumerate(layout.categorical):
        for s in range(layout.splits):
            own = frame.where((F.col(f"__r{s}") == TRAIN) & F.col("__y").isNotNull()).select(F.lit(c).alias("c"), F.lit(s).alias("s"), F.col(f"__c{j}").alias("v")).distinct()
            pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is not None:
        found = pairs.limit(most_levels + 1).collect()
        for r in found:
            levels.setdefault((r["c"], r["s"]), []).append(r["v"])
        if len(found) > most_levels:
            widest = max(levels, key=lambda k: len(levels[k]))[0]
            raise ValueError(f"more than {most_levels} levels of categorical columns over all splits, most in {widest!r}: exclude it or raise most_levels")
    out = []
    for s in range(layout.splits):
        fill = {c: float(fills[s, numeric[c]]) if c in numeric and np.isfinite(fills[s, numeric[c]]) else 0.0 for c in columns if kinds[s][c] == "numeric"}
        listed = {c: sorted_levels(levels.get((c, s), [])) for c in columns if kinds[s][c] != "numeric"}
        out.append(Design(tuple(columns), tuple(kinds[s][c] for c in columns), fill, listed))
    return out


@dataclass
class Factors:
    """r: (what, split, side) -> factor; what: ("micro",) or ("macro", recipe). rows and ranges of targets: (split, side)."""

    layout: Layout
    fits: Fits
    designs: list[Design]
    interventions: list[str]
    micro: list[str]
    r: dict[tuple, np.ndarray] = field(default_factory=dict)
    rows: dict[tuple[int, int], int] = field(default_factory=dict)
    low: dict[tuple[int, int], float] = field(default_factory=dict)
    high: dict[tuple[int, int], float] = field(default_factory=dict)
    state_rows: dict[tuple[int, int, int], np.ndarray] = field(default_factory=dict)
    development_rows: int = 0
    _micro: dict[int, float] = field(default_factory=dict)

    def sub_design(self, split: int, columns: list[str]) -> Design:
        d = self.designs[split]
        at = [d.columns.index(c) for c in columns]
        return replace(d, columns=tuple(columns), kinds=tuple(d.kinds[k] for k in at))

    def head(self, split: int) -> int:
        """Columns before the states: the intercept and the interventions."""
        return 1 + len(self.sub_design(split, self.interventions).terms())

    def state_groups(self, encoder: Encoder, split: int) -> list[list[int]]:
        """Raw states of each label that training rows with a target have, by the label's text; the first is reference."""
        occupied = self.state_rows[encoder.recipe.recipe_id, split, TRAIN] > 0
        groups: dict[int, list[int]] = {}
        for raw, label in encoder.state_map.items():
            groups.setdefault(label, []).append(raw)
        present = [g for g, members in groups.items() if any(occupied[k] for k in members)]
        return [groups[g] for g in sorted(present, key=str)]

    def macro_fit(self, encoder: Encoder, split: int, with_interventions: bool = True) -> tuple[Fit, list[list[int]]]:
        groups = self.state_groups(encoder, split)
        r = self.r["macro", encoder.recipe.recipe_id, split, TRAIN]
        head = self.head(split)
        if not with_interventions:
            r, head = np.hstack([r[:, :1], r[:, head:]]), 1
        reduced = merge_columns(r, head, groups[1:])
        names = ("__intercept__", *(t.name for t in self.sub_design(split, self.interventions).terms() if with_interventions), *(f"state={k}" for k in range(1, len(groups))))
        return fit_from_factor(reduced, self.rows[split, TRAIN], names), groups

    def macro_r2(self, encoder: Encoder, split: int, with_interventions: bool = True) -> float:
        fit, groups = self.macro_fit(encoder, split, with_interventions)
        r = self.r["macro", encoder.recipe.recipe_id, split, TEST]
        head = self.head(split)
        if not with_interventions:
            r, head = np.hstack([r[:, :1], r[:, head:]]), 1
        return held_out_r2(fit, merge_columns(r, head, groups[1:]), *self._range(split))

    def micro_fit(self, split: int) -> Fit:
        terms = self.sub_design(split, self.micro).terms()
        return fit_from_factor(self.r["micro", split, TRAIN], self.rows[split, TRAIN], ("__intercept__", *(t.name for t in terms)))

    def micro_r2(self, split: int) -> float:
        if split not in self._micro:
            self._micro[split] = held_out_r2(self.micro_fit(split), self.r["micro", split, TEST], *self._range(split))
        return self._micro[split]

    def _range(self, split: int) -> tuple[int, float, float]:
        return self.rows.get((split, TEST), 0), self.low.get((split, TEST), 0.0), self.high.get((split, TEST), 0.0)

    def outcome_specificity(self, encoder: Encoder) -> float:
        """Between-state share of the target's variance over all development rows with a target."""
        r = self.r["macro", encoder.recipe.recipe_id, 0, TRAIN]
        head, counts = self.head(0), self.state_rows[encoder.recipe.recipe_id, 0, TRAIN].astype(float)
        y = r[:, -1]
        sums = r[:, head:-1].T @ y  # the factor keeps inner products
        total = max(float((y[1:] ** 2).sum()) / max(self.rows[0, TRAIN], 1), 0.0)
        label: dict[int, list[int]] = {}
        for raw, k in encoder.state_map.items():
            label.setdefault(k, []).append(raw)
        n = np.array([counts[g].sum() for g in label.values()])
        s = np.array([sums[g].sum() for g in label.values()])
        has = n > 0
        return variance_share(n[has], s[has] / n[has], total)

    def score(self, encoder: Encoder, outcome: str, target: str) -> MacroScore:
        """Refit and score on every inner fold; a fold that cannot be refitted fails the candidate, all are listed."""
        if self.rows.get((0, TRAIN), 0) < 2:
            raise ValueError("scoring needs two rows with a target or more")
        macro, micro, states, topologies, failures = [], [], [], [], []
        for s in range(1, self.layout.splits):
            try:
                fresh = replay(encoder, self.fits.by[encoder.recipe.recipe_id, s])
            except TopologyError as error:
                failures.append({"fold_index": s - 1, "topology": error.diagnostics})
                continue
            topologies.append({"fold_index": s - 1, **topology(self.fits.by[encoder.recipe.recipe_id, s]), "merged": bool(encoder.merges), "identity": encoder.recipe.identity, "algorithm_version": 2})
            macro.append(self.macro_r2(fresh, s))
            micro.append(self.micro_r2(s))
            states.append(max(0.0, self.macro_r2(fresh, s, with_interventions=False)))
        if failures:
            raise ScoreTopologyError(encoder.name, failures)
        paired = PairedScores(tuple(macro), tuple(micro), GIVEN_SPLITS, tuple(f"fold-{k + 1}" for k in range(len(macro))))
        specificity = min(1.0, float(np.mean(states)))
        return MacroScore(encoder.name, outcome, target, paired, COMPUTED, specificity, self.outcome_specificity(encoder), len(encoder.labels), self.development_rows, tuple(topologies))


def build_factors(frame: DataFrame, layout: Layout, fits: Fits, recipes: list[Recipe], designs: list[Design], interventions: list[str], micro: list[str], sides: dict[int, tuple[int, ...]]) -> Factors:
    """One pass over the rows. sides: which sides of which splits to read (the outer holdout only when its time has come)."""
    numeric = {c: j for j, c in enumerate(layout.numeric)}
    categorical = {c: j for j, c in enumerate(layout.categorical)}
    out = Factors(layout, fits, designs, interventions, micro)
    plans = {s: (out.sub_design(s, interventions), out.sub_design(s, micro)) for s in sides}
    encoders = {(r.recipe_id, s): fits.by[r.recipe_id, s] for r in recipes for s in sides}

    def work(batch: Batch) -> Parts:
        parts: Parts = {}

        def put(key: tuple, value: np.ndarray) -> None:
            parts[key] = add(key, parts[key], value) if key in parts else value

        for s, wanted in sides.items():
            for side in wanted:
                rows = (batch.roles[:, s] == side) & np.isfinite(batch.y)
                n = int(rows.sum())
                if side == TRAIN and s == 0:
                    put(("sum", "development"), np.array([(batch.roles[:, 0] == TRAIN).sum()]))
                if not n:
                    continue
                y, one = batch.y[rows], np.ones((n, 1))
                put(("sum", "rows", s, side), np.array([n]))
                put(("min", s, side), np.array([y.min()]))
                put(("max", s, side), np.array([y.max()]))
                treated = plans[s][0].matrix(batch, rows, numeric, categorical)
                small = plans[s][1].matrix(batch, rows, numeric, categorical)
                put(("R", "micro", s, side), triangle(np.hstack([one, small, y[:, None]])))
                for r in recipes:
                    e = encoders[r.recipe_id, s]
                    raw = e.raw(batch.numbers[rows][:, [numeric[c] for c in r.columns]])
                    hot = (raw[:, None] == np.arange(e.raw_states)).astype(float)
                    put(("R", "macro", r.recipe_id, s, side), triangle(np.hstack([one, treated, hot, y[:, None]])))
                    put(("sum", "states", r.recipe_id, s, side), hot.sum(axis=0))
        return parts

    for key, value in run_pass(frame, layout, work).items():
        if key[0] == "R":
            out.r[key[1:]] = value
        elif key[1:] == ("development",):
            out.development_rows = int(value[0])
        elif key[1] == "rows":
            out.rows[key[2:]] = int(value[0])
        elif key[1] == "states":
            out.state_rows[key[2:]] = value
        elif key[0] == "min":
            out.low[key[1:]] = float(value[0])
        else:
            out.high[key[1:]] = float(value[0])
    for s, wanted in sides.items():  # sides without a row that has a target
        for side in wanted:
            out.rows.setdefault((s, side), 0)
    return out
