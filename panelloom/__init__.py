"""Panel analytics on Spark: lagged panels, leakage-safe splits, discretised states and least-squares scoring."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names by the module that holds them, imported when they are first asked for.
_PLACES = {
    "plans.discovery": ("DiscoveryConfig", "discover", "discover_file"),
    "plans.spec": ("AdjustmentSpec", "ColumnSpec", "StudySpec", "load_spec"),
    "operators.panel": ("Lagged", "build_lagged", "join_labels", "validate_panel"),
    "operators.splits": ("SplitPlan", "plan_splits"),
    "operators.encoders": ("TopologyError",),
    "operators.scoring": ("MacroScore", "PairedScores", "SCHEMA_VERSION", "ScoreTopologyError"),
}
_HOME = {name: place for place, names in _PLACES.items() for name in names}

__all__ = [*sorted(_HOME), "__version__"]


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f"panelloom.{_HOME[name]}"), name)
    raise AttributeError(name)
