"""Discretisations of feature columns into macro states: recipes, fitted encoders, merges, and their application.

An encoder is frozen once fitted and carries no data. It applies in NumPy inside passes, and compiles to a plain Spark
column for batch and streaming frames alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILE, COMPOSITE, KMEANS = "quantile", "composite_quantile", "kmeans"


class TopologyError(ValueError):
    """A merged recipe whose raw states can't be told apart again."""

    def __init__(self, message: str, diagnostics: dict):
        super().__init__(message)
        self.diagnostics = diagnostics


@dataclass(frozen=True)
class Recipe:
    """What to fit. number: bins, or states of k-means. recipe_id tells recipes of equal names apart."""

    recipe_id: int
    kind: str
    columns: tuple[str, ...]
    number: int

    def __post_init__(self) -> None:
        if self.number < 2:
            raise ValueError("bins or states must be 2 or more")

    @property
    def identity(self) -> str:
        return "canonical_lexicographic_centroid_rank" if self.kind == KMEANS else "bin_rank"


@dataclass(frozen=True)
class Encoder:
    """A fitted recipe. occupied: rows per raw state where it was fitted."""

    recipe: Recipe
    medians: tuple[float, ...]
    means: tuple[float, ...] = ()
    scales: tuple[float, ...] = ()
    cuts: tuple[float, ...] = ()
    centers: tuple[tuple[float, ...], ...] = ()
    occupied: tuple[int, ...] = ()
    merges: tuple[tuple[int, int], ...] = ()

    @property
    def name(self) -> str:
        r = self.recipe
        base = {QUANTILE: f"q{r.number}:{r.columns[0]}", COMPOSITE: f"q{r.number}:composite", KMEANS: f"kmeans:{len(self.centers)}"}[r.kind]
        return base + "".join(f"|merge:{a}+{b}" for a, b in self.merges)

    @property
    def method(self) -> str:
        return self.recipe.kind + "_merged" * len(self.merges)

    @property
    def raw_states(self) -> int:
        return len(self.centers) if self.recipe.kind == KMEANS else len(self.cuts) + 1

    @property
    def state_map(self) -> dict[int, int]:
        out = {k: k for k in range(self.raw_states)}
        for left, right in self.merges:
            out = {raw: left if now == right else now for raw, now in out.items()}
        return out

    @property
    def occupied_raw(self) -> list[int]:
        return [k for k, n in enumerate(self.occupied) if n]

    @property
    def labels(self) -> dict[int, int]:
        """Rows per present label."""
        out: dict[int, int] = {}
        for raw in self.occupied_raw:
            label = self.state_map[raw]
            out[label] = out.get(label, 0) + self.occupied[raw]
        return dict(sorted(out.items()))

    def merged(self, left: int, right: int) -> Encoder:
        """One more merge: right becomes left."""
        present = self.labels
        if left == right or left not in present or right not in present:
            raise ValueError("a merge needs two different states that are present")
        return replace(self, merges=(*self.merges, (int(left), int(right))))

    def possible_merges(self) -> list[Encoder]:
        present = list(self.labels)
        return [self.merged(a, b) for i, a in enumerate(present) for b in present[i + 1 :]]

    def raw(self, numbers: np.ndarray) -> np.ndarray:
        """Raw states of rows x the recipe's columns (NaN: missing)."""
        filled = np.where(np.isnan(numbers), np.array(self.medians), numbers)
        if self.recipe.kind == QUANTILE:
            return np.searchsorted(np.array(self.cuts), filled[:, 0], side="left")
        z = (filled - np.array(self.means)) / np.array(self.scales)
        if self.recipe.kind == COMPOSITE:
            return np.searchsorted(np.array(self.cuts), z.mean(axis=1), side="left")
        return nearest(z, np.array(self.centers))

    def column(self, cells: list[Column]) -> Column:
        """The state as an expression of the recipe's columns as doubles (null: missing)."""
        filled = [F.coalesce(c, F.lit(m)) for c, m in zip(cells, self.medians, strict=True)]
        if self.recipe.kind == QUANTILE:
            raw = _above(filled[0], self.cuts)
        else:
            z = [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(filled, self.means, self.scales, strict=True)]
            if self.recipe.kind == COMPOSITE:
                total = z[0]
                for c in z[1:]:
                    total = total + c
                raw = _above(total / F.lit(float(len(z))), self.cuts)
            else:
                distance = []
                for center in self.centers:
                    parts = [(c - F.lit(x)) * (c - F.lit(x)) for c, x in zip(z, center, strict=True)]
                    total = parts[0]
                    for part in parts[1:]:
                        total = total + part
                    distance.append(total)
                both = F.array(*distance)
                raw = (F.array_position(both, F.array_min(both)) - 1).cast("int")
        out = raw
        if self.merges:
            for k, label in self.state_map.items():
                out = F.when(raw == k, F.lit(label)) if k == 0 else out.when(raw == k, F.lit(label))
        return out.cast("int")

    def to_dict(self) -> dict:
        r = self.recipe
        out = {
            "version": 1, "algorithm_version": 2, "recipe": r.kind, "identity": r.identity, "columns": list(r.columns),
            "medians": dict(zip(r.columns, self.medians, strict=True)), "state_map": {str(k): v for k, v in self.state_map.items()},
            "fit_observed_states": len(self.occupied_raw), "fit_occupied_raw_states": self.occupied_raw,
        }
        if r.kind != QUANTILE:
            out["preprocess"] = {c: {"median": m, "mean": a, "scale": s} for c, m, a, s in zip(r.columns, self.medians, self.means, self.scales, strict=True)}
        if r.kind == KMEANS:
            out |= {"requested_states": r.number, "states": len(self.centers), "centers": [list(c) for c in self.centers]}
        else:
            out |= {"bins": r.number, "cutpoints": list(self.cuts)}
        if self.merges:
            out["merges"] = [{"left": a, "right": b} for a, b in self.merges]
        return out

    @classmethod
    def from_dict(cls, value: dict, recipe_id: int = 0) -> Encoder:
        """Read back to_dict; foreign identities of merged k-means recipes are rejected."""
        kind, columns = value["recipe"], tuple(value["columns"])
        if kind not in (QUANTILE, COMPOSITE, KMEANS):
            raise ValueError(f"unknown recipe {kind!r}")
        recipe = Recipe(recipe_id, kind, columns, value["requested_states"] if kind == KMEANS else value["bins"])
        if kind == KMEANS and value.get("merges") and (value.get("algorithm_version", 1) < 2 or value.get("identity") != recipe.identity):
            raise TopologyError("a merged k-means recipe without stable state identities", {"recipe": kind, "reason": "unsupported_legacy_identity"})
        steps = value.get("preprocess") or {}
        raw = len(value.get("centers", ())) if kind == KMEANS else len(value["cutpoints"]) + 1
        seen = set(value.get("fit_occupied_raw_states") or ())
        out = cls(
            recipe,
            tuple(value["medians"][c] for c in columns),
            tuple(steps[c]["mean"] for c in columns) if steps else (),
            tuple(steps[c]["scale"] for c in columns) if steps else (),
            tuple(value.get("cutpoints", ())),
            tuple(tuple(c) for c in value.get("centers", ())),
            tuple(int(k in seen) for k in range(raw)),
            tuple((m["left"], m["right"]) for m in value.get("merges", ())),
        )
        if {str(k): v for k, v in out.state_map.items()} != value["state_map"]:
            raise TopologyError("the state map is not what the merges give", {"recipe": kind, "reason": "corrupted_source_merge_map"})
        return out


def _above(value: Column, cuts: tuple[float, ...]) -> Column:
    """How many cuts lie strictly below the value."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (value > F.lit(cut)).cast("int")
    return out


def nearest(z: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center by squared distance; the lowest index wins ties."""
    best, at = None, None
    for k, center in enumerate(centers):
        d = ((z - center) ** 2).sum(axis=1)
        if best is None:
            best, at = d, np.zeros(len(z), np.int64)
        else:
            closer = d < best
            best, at = np.where(closer, d, best), np.where(closer, k, at)
    return at


def topology(encoder: Encoder) -> dict:
    """Requested and observed raw states and cuts."""
    bins = encoder.recipe.kind != KMEANS
    return {
        "recipe": encoder.recipe.kind,
        "requested_states": encoder.recipe.number,
        "observed_states": len(encoder.occupied_raw),
        "expected_cutpoints": encoder.recipe.number - 1 if bins else None,
        "observed_cutpoints": len(encoder.cuts) if bins else None,
    }


def require_topology(encoder: Encoder, phase: str) -> None:
    """A merged recipe needs all of its raw states, occupied and distinct."""
    t = topology(encoder)
    complete = t["observed_states"] == t["requested_states"] and t["observed_cutpoints"] == t["expected_cutpoints"]
    if not complete:
        source = phase == "source" and encoder.recipe.kind != KMEANS and encoder.occupied_raw != list(range(encoder.recipe.number))
        reason = "unsupported_source_topology" if source else "incomplete_refit_topology"
        raise TopologyError("a merged recipe lost a raw state", {**t, "reason": reason, "phase": phase})


def replay(source: Encoder, fresh: Encoder) -> Encoder:
    """The fresh fit of a recipe with the merges of the source."""
    if not source.merges:
        return fresh
    require_topology(source, "source")
    require_topology(fresh, "refit")
    groups = set(range(fresh.raw_states))
    for k, (left, right) in enumerate(source.merges):
        if left == right or left not in groups or right not in groups:
            raise TopologyError("a merge names a state that is gone", {**topology(fresh), "reason": "invalid_chained_merge_operands", "merge_index": k, "left": left, "right": right})
        groups.discard(right)
    return replace(fresh, merges=source.merges)


@dataclass
class Fits:
    """Encoders of each recipe on each split (0: all development rows)."""

    recipes: list[Recipe]
    by: dict[tuple[int, int], Encoder] = field(default_factory=dict)
