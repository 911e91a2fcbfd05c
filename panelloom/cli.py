"""validate and discover on the command line."""

from __future__ import annotations

import argparse
import json
import sys

from panelloom.operators.panel import validate_panel
from panelloom.plans.discovery import DiscoveryConfig, discover
from panelloom.plans.spec import load_spec
from panelloom.operators.splits import MODES
from panelloom.runtime import local_session
from panelloom.sources.tables import read_panel, strict_json, write_json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="panelloom", description="Macro states of longitudinal panels, on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("validate", "discover"):
        c = commands.add_parser(name)
        c.add_argument("panel", help="CSV, Parquet, ORC or JSON lines")
        c.add_argument("spec", help="study as .json")
        c.add_argument("--json", action="store_true", help="print JSON")
        if name == "discover":
            base = DiscoveryConfig()
            c.add_argument("--outcome")
            for key in ("lag", "max_states", "paths", "branching_factor", "folds", "top_k", "seed"):
                c.add_argument(f"--{key.replace('_', '-')}", type=int, default=getattr(base, key))
            c.add_argument("--holdout-fraction", type=float, default=base.holdout_fraction)
            c.add_argument("--validation-mode", choices=MODES, default=base.validation_mode)
            c.add_argument("--split-hash", choices=("permutation", "md5"), default=base.split_hash)
            c.add_argument("--output", help="write the JSON document here")
    return out


def summary_text(d: dict) -> str:
    """A discovery for readers."""
    number = lambda v: "n/a" if v is None else f"{v:.4f}"
    lines = [
        f"{d['panel']['row_count']} rows, {d['panel']['entity_count']} entities; outcome {d['config']['outcome']}, lag {d['config']['lag']}, {d['config']['validation_mode']}",
        "Candidates (development rows; a heuristic ranking, evidence not assessed):",
    ]
    for k, r in enumerate(d["top_macros"], 1):
        lines.append(f"  {k}. {r['macro_name']}: score {number(r['ranking_score'])}, macro R2 {number(r['macro_r2'])}, micro R2 {number(r['micro_r2'])}, {r['state_count']} states, compression {number(r['compression'])}")
    o = d["outer_evaluation"]
    lines.append(f"Holdout: {o['status']}, macro R2 {number(o['macro_r2'])}, micro R2 {number(o['micro_r2'])}, {o['finite_test_targets']} of {o['test_rows']} rows with a target")
    for p in d["candidate_pathways"]:
        if p["terms"]:
            lines += [f"  {p['intervention']} [{t['feature_name']}]: {number(t['coefficient'])} (IID error {number(t['stderr'])}, {t['uncertainty_status']})" for t in p["terms"]]
        else:
            lines.append(f"  {p['intervention']}: {p['status']}")
    return "\n".join([*lines, *(f"Note: {w}" for w in d["warnings"])])


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        spec = load_spec(a.spec)
        spark = local_session()
        panel = read_panel(spark, a.panel)
        if a.command == "validate":
            s = validate_panel(panel, spec)
            value = {"row_count": s.row_count, "entity_count": s.entity_count, "columns": list(s.observed_columns), "duplicate_entity_times": s.duplicate_entity_times, "warnings": list(s.warnings)}
            print(strict_json(value) if a.json else "\n".join(f"{k}: {v}" for k, v in value.items()))
            return 0
        keys = DiscoveryConfig.__dataclass_fields__
        d = discover(panel, spec, DiscoveryConfig(**{k: v for k, v in vars(a).items() if k in keys}))
        if a.output:
            write_json(d, a.output)
        print(strict_json(d, indent=2) if a.json else summary_text(d))
        return 0
    except (FileNotFoundError, ValueError, json.JSONDecodeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
