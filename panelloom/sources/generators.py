"""Panels with known mechanisms: entity_id, time, x1..x3, extras and y, where y at t+1 follows from the features at t."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelloom.plans.spec import StudySpec


@dataclass(frozen=True)
class Panel:
    """columns: name -> flat array, entity by entity; truth: what is known of the mechanism."""

    case: str
    columns: dict[str, np.ndarray]
    spec: StudySpec
    truth: dict = field(default_factory=dict)
    oracle: tuple[str, ...] = ()
    labels: np.ndarray | None = None

    def label_frame(self, spark: SparkSession, name: str = "prespecified") -> DataFrame:
        """The states that the case declares beforehand, by entity and time; they are not part of the panel."""
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({c: self.columns[c] for c in ("entity_id", "time")} | {name: self.labels}))

    def frame(self, spark: SparkSession) -> DataFrame:
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(self.columns))


def _additive(x, rng, border, held):
    return 1.5 * x[0] - 0.8 * x[1], {}, {"coefficients": {"x1": 1.5, "x2": -0.8}}


def _threshold(x, rng, border, held):
    step = (x[0] > 0).astype(np.int64)
    return 2.0 * step, {"oracle_threshold": step}, {"threshold": 0.0}


def _interaction(x, rng, border, held):
    sign = np.sign(x[0]) * np.sign(x[1])
    return 1.5 * sign, {"oracle_sign_product": sign}, {}


def _fingerprint(x, rng, border, held):
    level = rng.normal(0, 2, (x.shape[1], 1))
    marker = np.array([f"m{k:04d}" for k in range(x.shape[1])], dtype=object)
    return np.repeat(level, x.shape[2], axis=1), {"entity_marker": np.repeat(marker[:, None], x.shape[2], axis=1)}, {}


def _drift(x, rng, border, held):
    slope = np.where(np.arange(x.shape[2]) < border, 1.5, -1.5)
    return slope * x[0], {}, {"slopes": [1.5, -1.5]}


def _rare(x, rng, border, held):
    entity, tail = np.zeros((2, *x.shape[1:]), np.int64)
    entity[held] = 1
    tail[held, border] = 1
    return 0.5 * x[0], {"rare_entity_state": entity, "rare_tail_state": tail}, {"coefficients": {"x1": 0.5}}


def _confounding(x, rng, border, held):
    u = rng.normal(size=x.shape[1:])
    t = u + 0.5 * rng.normal(size=u.shape)
    return 1.5 * t + 4.0 * u, {"u": u, "treatment": t}, {"coefficients": {"treatment": 1.5, "u": 4.0}}


def _correlated(x, rng, border, held):
    u, w = rng.normal(size=x.shape[1:]), rng.normal(size=x.shape[1:])
    a = u + 0.45 * w + 0.3 * rng.normal(size=u.shape)
    b = 0.8 * u + 0.45 * w + 0.3 * rng.normal(size=u.shape)
    return 1.7 * a - 0.9 * b + 1.2 * u, {"u": u, "treatment_a": a, "treatment_b": b}, {"coefficients": {"treatment_a": 1.7, "treatment_b": -0.9, "u": 1.2}}


def _shift(x, rng, border, held):
    x[0][:, border:] += 1.5
    return 1.5 * x[0], {}, {"coefficients": {"x1": 1.5}}


#: The states that a case declares beforehand, from its features, extras and border.
LABELS = {
    "iid_null": lambda x, more, border: np.zeros(x.shape[1:]),
    "additive_signal": lambda x, more, border: x[0] > 0,
    "nonlinear_threshold": lambda x, more, border: more["oracle_threshold"],
    "sign_interaction": lambda x, more, border: more["oracle_sign_product"] > 0,
    "entity_fingerprint": lambda x, more, border: np.repeat(np.arange(x.shape[1])[:, None], x.shape[2], axis=1),
    "temporal_drift": lambda x, more, border: np.broadcast_to(np.arange(x.shape[2]) >= border, x.shape[1:]),
    "rare_absent_states": lambda x, more, border: more["rare_tail_state"] + 2 * more["rare_entity_state"],
    "known_confounding": lambda x, more, border: more["u"] > 0,
    "correlated_treatments": lambda x, more, border: more["treatment_a"] > more["treatment_b"],
    "population_shift": lambda x, more, border: np.broadcast_to(np.arange(x.shape[2]) >= border, x.shape[1:]),
}

CASES = {
    "iid_null": lambda x, rng, border, held: (np.zeros(x.shape[1:]), {}, {}),
    "additive_signal": _additive,
    "nonlinear_threshold": _threshold,
    "sign_interaction": _interaction,
    "entity_fingerprint": _fingerprint,
    "temporal_drift": _drift,
    "rare_absent_states": _rare,
    "known_confounding": _confounding,
    "correlated_treatments": _correlated,
    "population_shift": _shift,
}


def generate(case: str, entities: int = 48, periods: int = 16, seed: int = 0, fraction: float = 0.25, split_seed: int = 17) -> Panel:
    """One panel of a case. fraction: where the forward border lies, for cases that change there, among rows with a later row.

    split_seed: the seed of the split by entities; the rare states belong to the first entity that it holds out.
    """
    if case not in CASES:
        raise ValueError(f"case must be one of {', '.join(CASES)}")
    rng = np.random.default_rng(seed)
    names = np.array([f"e{k:04d}" for k in range(entities)], dtype=object)
    held = int(np.random.default_rng(split_seed).permutation(names)[0][1:])
    x = rng.normal(size=(3, entities, periods))
    border = min(max(periods - 1 - int(np.ceil((periods - 1) * fraction)), 1), periods - 2)
    mean, extras, truth = CASES[case](x, rng, border, held)
    y = rng.normal(size=(entities, periods))
    y[:, 1:] += mean[:, :-1]
    columns = {"entity_id": np.repeat(names, periods), "time": np.tile(np.arange(periods), entities)}
    columns |= {f"x{k + 1}": x[k].ravel() for k in range(3)} | {k: v.ravel() for k, v in extras.items()} | {"y": y.ravel()}
    treatments = [c for c in extras if c.startswith("treatment")]
    oracle = tuple(c for c in extras if c.startswith("oracle"))
    spec = {
        "dataset": {"id_column": "entity_id", "time_column": "time"},
        "outcomes": ["y"],
        "interventions": treatments,
        "exclude": list(oracle),
        "columns": {"y": {"role": "outcome", "type": "numeric", "allowed_as_cause": False, "allowed_as_adjustment": False}},
    }
    if "u" in extras:
        spec["columns"]["u"] = {"role": "covariate", "type": "numeric"}
        spec["adjustment"] = {"columns": ["u"], "rationale": "a measured common cause"}
    return Panel(case, columns, StudySpec.from_dict(spec), truth, oracle, LABELS[case](x, extras, border).astype(np.int64).ravel())
