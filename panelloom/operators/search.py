"""Branching greedy search over merges of states, on factors alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from panelloom.operators.encoders import Encoder
from panelloom.operators.scoring import MacroScore, ScoreTopologyError

SCOPE = "candidates supported on every required development fold"


Signature = tuple


def signature(encoder: Encoder) -> Signature:
    """What the labels of all rows are decided by."""
    return encoder.recipe.recipe_id, tuple(encoder.state_map[k] for k in encoder.occupied_raw)


@dataclass(frozen=True)
class Node:
    """A scored encoder and the scored encoders that led to it."""

    encoder: Encoder
    score: MacroScore
    before: Node | None = None

    @property
    def rank(self) -> tuple:
        return self.score.rank_key

    @property
    def states(self) -> int:
        return len(self.encoder.labels)

    @property
    def path(self) -> list[dict]:
        return [*(self.before.path if self.before else []), record(self)]


class ScoreTable:
    """Scores by name, each asked for once; the best node of each signature; and what could not be refitted."""

    def __init__(self, score: Callable[[Encoder], MacroScore]):
        self._score = score
        self._rows: dict[tuple, MacroScore | ScoreTopologyError] = {}
        self.best: dict[Signature, Node] = {}
        self.rejected: dict[Signature, dict] = {}

    def visit(self, encoder: Encoder, before: Node | None = None) -> Node | None:
        row = self._rows.setdefault((encoder.name, encoder.recipe.recipe_id), None) or self._fill(encoder)
        if isinstance(row, ScoreTopologyError):
            return None
        node, place = Node(encoder, row, before), signature(encoder)
        self.best[place] = max(self.best.get(place, node), node, key=lambda n: n.rank)
        return node

    def _fill(self, encoder: Encoder) -> MacroScore | ScoreTopologyError:
        try:
            row = self._score(encoder)
        except ScoreTopologyError as error:
            row = error
            self.rejected[signature(encoder)] = {"macro_name": encoder.name, "method": encoder.method, "status": error.status, "comparable": False, "diagnostics": error.diagnostics}
        self._rows[encoder.name, encoder.recipe.recipe_id] = row
        return row


@dataclass
class SearchResult:
    start: Encoder
    status: str
    best: Node | None
    sampled: list[Node]
    paths: list[list[dict]]
    rejected: list[dict]

    def to_dict(self) -> dict:
        return {
            "initial_macro": self.start.name,
            "status": self.status,
            "best": None if self.best is None else record(self.best),
            "sampled_macro_count": len(self.sampled),
            "sampled_macros": [record(n) for n in self.sampled],
            "paths": self.paths,
            "rejected_candidates": self.rejected,
            "ranking_scope": SCOPE,
        }


def record(node: Node) -> dict:
    e = node.encoder
    return node.score.to_dict() | {
        "status": "valid",
        "comparable": True,
        "method": e.method,
        "feature_columns": list(e.recipe.columns),
        "recipe_id": e.recipe.recipe_id,
        "recipe_identity": e.recipe.identity,
        "recipe_algorithm_version": 2,
        "state_sizes": {str(k): v for k, v in e.labels.items()},
        "encoder": e.to_dict(),
    }


def best_of(nodes: Iterable[Node], most: int | None = None) -> list[Node]:
    return sorted(nodes, key=lambda n: n.rank, reverse=True)[:most]


def search(start: Encoder, score: Callable[[Encoder], MacroScore], n_paths: int = 10, branching_factor: int = 2, min_states: int = 2) -> SearchResult:
    """Level by level, from the start's number of states down: nodes of a level give way to their best few merges and
    compete with these and with all that ended earlier for the places of the beam. Whatever was scored may win."""
    if min(n_paths, branching_factor, min_states) < 1:
        raise ValueError("n_paths, branching_factor and min_states must be 1 or more")
    table = ScoreTable(score)
    beam = [n for n in [table.visit(start)] if n]
    for level in range(len(start.labels), min_states, -1):
        offers: list[Node] = []
        for node in beam:
            merges = [m for e in node.encoder.possible_merges() if (m := table.visit(e, node))] if node.states == level else []
            offers += best_of(merges, branching_factor) or [node]
        beam = best_of(offers, n_paths)
    rejected = list(table.rejected.values())
    if not beam:
        return SearchResult(start, "no_valid_candidate", None, [], [], rejected)
    ranked = best_of(table.best.values())
    return SearchResult(start, "partial_topology_rejections" if rejected else "complete", ranked[0], ranked, [n.path for n in beam], rejected)
