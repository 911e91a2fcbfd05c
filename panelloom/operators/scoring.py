"""Scores of macro states: held-out fit, state-only fit, fold dispersion and compression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

SCHEMA_VERSION = 2
#: Weights of the ranking preference and names of what specificity means.
WEIGHTS = {"macro_r2": 0.45, "specificity": 0.25, "stability": 0.20, "compression": 0.10}
HELD_OUT = "mean_positive_clipped_validation_r2_of_training_fitted_state_means"
DESCRIPTIVE = "descriptive_between_state_outcome_variance_share"
COMPUTED, DECLARED = "computed_training_only_refit", "caller_declared"
GIVEN_SPLITS, ROW_MODULO = "provided_validation_splits_training_only_refit", "row_modulo_refit_cv"


class ScoreTopologyError(ValueError):
    """A candidate that some folds can't refit, with all of these folds."""

    status = "not_comparable_refit_topology"

    def __init__(self, name: str, failures: list[dict]):
        super().__init__(f"{name}: {len(failures)} folds cannot be refitted")
        self.diagnostics = {"failed_folds": failures}


def fold_stability(scores: list[float]) -> float:
    """1 / (1 + population deviation) of raw fold scores; 0 for a single fold."""
    return 0.0 if len(scores) < 2 else float(1 / (1 + np.std(scores)))


def fold_deviation(scores: list[float]) -> float | None:
    return None if len(scores) < 2 else float(np.std(scores))


def compression_score(states: int, rows: int) -> float:
    """1 - log(states) / log(rows), within [0, 1]; 0 for a single state."""
    if states <= 1:
        return 0.0
    return float(min(1.0, max(0.0, 1 - math.log2(states) / math.log2(max(rows, 2)))))


def variance_share(counts: np.ndarray, means: np.ndarray, total_variance: float) -> float:
    """Between-state share of the target's variance, within [0, 1]; 0 without variance or for fewer than two rows."""
    n = counts.sum()
    if n < 2 or not total_variance > 0:
        return 0.0
    grand = (counts * means).sum() / n
    between = (counts * (means - grand) ** 2).sum() / n
    return float(min(1.0, max(0.0, between / total_variance)))


def ranking_components(macro_r2: float, specificity: float, stability: float, compression: float) -> dict[str, float]:
    parts = {"macro_r2": max(macro_r2, 0.0), "specificity": specificity, "stability": stability, "compression": compression}
    return {k: WEIGHTS[k] * v for k, v in parts.items()}


@dataclass(frozen=True)
class PairedScores:
    """Held-out R2 of a macro and a micro model on the same folds."""

    macro: tuple[float, ...]
    micro: tuple[float, ...]
    scope: str
    ids: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        names = self.ids if self.ids is not None else tuple(map(str, range(len(self.macro))))
        wanted = {
            "as many macro as micro folds, at least one": 0 < len(self.macro) == len(self.micro),
            "finite values": bool(np.isfinite([*self.macro, *self.micro]).all()),
            "a scope": bool(self.scope.strip()),
            "a name of its own for each fold": len(names) == len(self.macro) == len({n for n in names if isinstance(n, str) and n.strip()}),
        }
        if missing := [what for what, given in wanted.items() if not given]:
            raise ValueError("paired scores need " + ", ".join(missing))

    @property
    def differences(self) -> tuple[float, ...]:
        return tuple(a - b for a, b in zip(self.macro, self.micro, strict=True))


@dataclass(frozen=True)
class MacroScore:
    """A candidate's record; what can be derived from other numbers is derived, so it cannot disagree."""

    name: str
    outcome: str
    target: str
    paired: PairedScores
    provenance: str
    validation_specificity: float | None
    outcome_specificity: float
    state_count: int
    row_count: int
    topologies: tuple[dict, ...] = ()

    def __post_init__(self) -> None:
        if self.provenance not in (COMPUTED, DECLARED):
            raise ValueError("unknown provenance of predictive scores")
        if not 1 <= self.state_count <= self.row_count:
            raise ValueError("states must be 1 or more and no more than rows")
        for v in (self.outcome_specificity, self.specificity, self.stability, self.compression):
            if not (math.isfinite(v) and 0 <= v <= 1):
                raise ValueError("specificity, stability and compression lie within 0 and 1")

    @property
    def macro_r2(self) -> float:
        return float(np.mean(self.paired.macro))

    @property
    def micro_r2(self) -> float:
        return float(np.mean(self.paired.micro))

    @property
    def specificity(self) -> float:
        return self.outcome_specificity if self.validation_specificity is None else self.validation_specificity

    @property
    def stability(self) -> float:
        return fold_stability(list(self.paired.macro))

    @property
    def compression(self) -> float:
        return compression_score(self.state_count, self.row_count)

    @property
    def components(self) -> dict[str, float]:
        return ranking_components(self.macro_r2, self.specificity, self.stability, self.compression)

    @property
    def ranking_score(self) -> float:
        return float(sum(self.components.values()))

    @property
    def rank_key(self) -> tuple:
        return self.ranking_score, self.specificity, self.state_count, self.name

    def to_dict(self) -> dict:
        return {
            "score_schema_version": SCHEMA_VERSION,
            "macro_name": self.name,
            "outcome": self.outcome,
            "target_column": self.target,
            "ranking_score": self.ranking_score,
            "ranking_components": self.components,
            "ranking_weights": dict(WEIGHTS),
            "predictive_r2_difference": self.macro_r2 - self.micro_r2,
            "predictive_provenance": self.provenance,
            "predictive_evaluation_scope": self.paired.scope,
            "predictive_evaluation_ids": None if self.paired.ids is None else list(self.paired.ids),
            "emergence_evidence_status": "not_assessed",
            "macro_r2": self.macro_r2,
            "micro_r2": self.micro_r2,
            "specificity": self.specificity,
            "validation_specificity": self.validation_specificity,
            "outcome_specificity": self.outcome_specificity,
            "specificity_definition": DESCRIPTIVE if self.validation_specificity is None else HELD_OUT,
            "stability": self.stability,
            "compression": self.compression,
            "state_count": self.state_count,
            "row_count": self.row_count,
            "macro_fold_scores": list(self.paired.macro),
            "micro_fold_scores": list(self.paired.micro),
            "fold_r2_differences": list(self.paired.differences),
            "macro_fold_r2_std": fold_deviation(list(self.paired.macro)),
            "micro_fold_r2_std": fold_deviation(list(self.paired.micro)),
            "fold_refit_topologies": [dict(t) for t in self.topologies],
        }
