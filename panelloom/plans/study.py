"""Replicate studies: profiles, trials, intervals and summaries."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import statistics
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cells import number
from panelloom.operators.ols import fit_from_factor
from panelloom.operators.passes import Batch, Layout, run_pass, triangle
from panelloom.plans.comparators import COMPARATORS, LABEL, Sides, compare, confounding_coefficients, outer_sides, state_support
from panelloom.plans.discovery import DiscoveryConfig, discover
from panelloom.runtime import scratch_for
from panelloom.sources.generators import CASES, Panel, generate
from panelloom.sources.tables import JsonLines, strict_json

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_critical(df: int) -> float:
    """The upper 97.5 % point of Student's t: with t = sqrt(df) * tan(a), its distribution is an integral of cos(a)**(df - 1)."""
    if df < 1:
        raise ValueError("t needs a degree of freedom")
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def share(a: float) -> float:
        return scale * a / 2 * float(_WEIGHTS @ np.cos(a * (_NODES + 1) / 2) ** (df - 1))

    low, high = 0.0, min(math.pi / 2, 13 / math.sqrt(df))
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle) < 0.475 else (low, middle)
    return math.sqrt(df) * math.tan((low + high) / 2)


def mean_interval(values: list[float], draws: int = 2000, seed: int = 0) -> dict:
    """Mean, Monte Carlo error, t interval and percentile bootstrap interval."""
    x = np.asarray(values, float)
    if not len(x):
        return {"n": 0, "mean": None, "mc_se": None, "t_interval": None, "bootstrap_interval": None}
    mean = float(x.mean())
    if len(x) < 2:
        return {"n": 1, "mean": mean, "mc_se": None, "t_interval": None, "bootstrap_interval": None}
    se = float(x.std(ddof=1) / math.sqrt(len(x)))
    half = t_critical(len(x) - 1) * se
    again = np.random.default_rng(seed).choice(x, (draws, len(x))).mean(axis=1)
    return {"n": len(x), "mean": mean, "mc_se": se, "t_interval": [mean - half, mean + half], "bootstrap_interval": np.quantile(again, [0.025, 0.975]).tolist()}


def wilson_interval(hits: int, n: int) -> tuple[float, float]:
    if n < 1 or not 0 <= hits <= n:
        raise ValueError("Wilson's interval needs 0 <= hits <= n and n of 1 or more")
    z, p = 1.959963984540054, hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, middle - half), min(1.0, middle + half)


#: How often a Poisson variable of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def cluster_bootstrap_interval(
    frame: DataFrame, id_column: str, target: str, treatment: str, covariates: list[str], draws: int = 200, seed: int = 0, least_share: float = 0.8
) -> tuple[float, float, int]:
    """(2.5 %, 97.5 %, finite draws) of a least-squares coefficient over resampled entities.

    Entities get independent Poisson weights of mean 1 by a hash of id and draw, which is resampling with replacement for
    any number of entities without listing them. One pass makes the factors of all draws.
    """
    types = {f.name: f.dataType for f in frame.schema.fields}
    columns = [treatment, *covariates]
    entity = F.pmod(F.xxhash64(F.col(f"`{id_column}`").cast("string"), F.lit(seed)), F.lit(1 << 52)).cast("double").alias("__n0")
    cells = [number(c, types[c]).alias(f"__n{k + 1}") for k, c in enumerate(columns)]
    rows = frame.select(number(target, types[target]).alias("__y"), F.lit(1).cast("tinyint").alias("__r0"), entity, *cells)
    layout = Layout(1, ("entity", *columns), ())

    def work(batch: Batch) -> dict:
        ok = np.isfinite(batch.y) & np.isfinite(batch.numbers).all(axis=1)
        if not ok.any():
            return {}
        x = np.column_stack([np.ones(ok.sum()), batch.numbers[ok, 1:], batch.y[ok]])
        key = batch.numbers[ok, 0].astype(np.uint64)
        out = {}
        for d in range(draws):
            h = (key + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            weight = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) / (1 << 53), side="right")
            out["R", d] = triangle(x * np.sqrt(weight)[:, None])
            out["sum", d] = np.array([weight.sum()])
        return out

    got = run_pass(rows, layout, work)
    found = []
    for d in range(draws):
        if ("R", d) in got:
            fit = fit_from_factor(got["R", d], max(2, int(got["sum", d][0])), ("__intercept__", *columns))
            if fit.estimable[1] and np.isfinite(fit.beta[1]):
                found.append(float(fit.beta[1]))
    if len(found) < least_share * draws:
        raise ValueError(f"only {len(found)} of {draws} draws have a coefficient")
    low, high = np.quantile(found, [0.025, 0.975])
    return float(low), float(high), len(found)


#: The cells of the study.
CELLS = tuple((c, "entity_holdout") for c in CASES if c not in ("temporal_drift", "population_shift")) + (
    ("entity_fingerprint", "interpolation"), ("temporal_drift", "forward_time"), ("temporal_drift", "interpolation"), ("population_shift", "forward_time"),
)


@dataclass(frozen=True)
class Profile:
    cells: tuple[tuple[str, str], ...] = CELLS
    panels: int = 32
    entities: int = 48
    periods: int = 16
    seed_family: int = 20261002
    least_state_rows: int = 20
    least_state_entities: int = 5
    draws: int = 1999
    config: DiscoveryConfig = field(default_factory=lambda: DiscoveryConfig(max_states=3, paths=2, folds=3, holdout_fraction=0.25, seed=17))

    def seeds(self, cell: int) -> list[int]:
        child = np.random.SeedSequence(self.seed_family).spawn(len(self.cells))[cell]
        return [int(s.generate_state(1)[0]) for s in child.spawn(self.panels)]

    def digest(self) -> str:
        text = strict_json([[list(c) for c in self.cells], self.panels, self.entities, self.periods, self.seed_family, self.least_state_rows, self.least_state_entities, self.draws, str(self.config)])
        return hashlib.sha256(text.encode()).hexdigest()


FULL = Profile()
QUICK = Profile(panels=2, entities=24, periods=12, draws=100)


def run_trial(spark: SparkSession, case: str, split: str, seed: int, profile: Profile = QUICK) -> dict:
    """Generate, discover, compare and record; a failure is a record and is not tried again.

    The holdout figures of the discovery must come out again from models fitted apart from it, within 1e-8.
    """
    base = {"case": case, "split": split, "seed": seed}
    try:
        panel = generate(case, profile.entities, profile.periods, seed, profile.config.holdout_fraction, profile.config.seed)
        config = DiscoveryConfig(**{**profile.config.__dict__, "validation_mode": split})
        scratch = scratch_for(spark, "trial")
        frame = scratch.save(lambda: panel.frame(spark), "panel")
        d = discover(frame, panel.spec, config)
        outer, best = d["outer_evaluation"], d["top_macros"][0]
        record = base | {
            "status": "success" if outer["status"] == "evaluated" else "not_evaluable",
            "macro_r2": outer["macro_r2"],
            "micro_r2": outer["micro_r2"],
            "compression": best["compression"],
            "selected_family": best["macro_name"].split("|")[0].split(":")[0],
            "selected_macro": best["macro_name"],
            "selected_state_count": best["state_count"],
            "adjusted": {p["intervention"]: p["coefficient"] for p in d["candidate_pathways"]},
            "rejected_candidates": sum(len(s["rejected_candidates"]) for s in d["searches"]),
            "failure_reason": None,
        }
        if outer["status"] == "evaluated":
            record |= _comparison(outer_sides(frame, panel.spec, d, scratch, panel.label_frame(spark)), panel, d, profile)
    except (ValueError, ArithmeticError) as error:
        return base | {"status": "failed", "failure_reason": str(error)}
    return record


def _comparison(sides: Sides, panel: Panel, document: dict, profile: Profile) -> dict:
    paired, treatments = compare(sides, document), document["columns"]["interventions"]
    for ours, theirs in (("selected_macro", "macro_r2"), ("restricted_micro", "micro_r2")):
        if not math.isclose(paired[ours], document["outer_evaluation"][theirs], rel_tol=1e-8, abs_tol=1e-8):
            raise ArithmeticError(f"{theirs} does not come out again: {paired[ours]} for {document['outer_evaluation'][theirs]}")
    support = state_support(sides, panel.spec.id_column)
    thin = [s["state"] for s in support if s["train_rows"] and (s["train_rows"] < profile.least_state_rows or s["train_entities"] < profile.least_state_entities)]
    out = {"paired_r2": paired, "oracle_r2": sides.r2([*treatments, *panel.oracle]) if panel.oracle else None}
    out |= {"support": support, "thin_states": thin, "prespecified_support": state_support(sides, panel.spec.id_column, LABEL)}
    if treatments and "u" in sides.train.columns:
        found = confounding_coefficients(sides.train, sides.target, treatments, "u")
        native = {p["intervention"]: p["coefficient"] for p in document["candidate_pathways"]}
        for name, value in found["joint_raw_confounder"].items():
            if not math.isclose(value, native[name], rel_tol=1e-8, abs_tol=1e-8):
                raise ArithmeticError(f"the coefficient of {name} does not come out again: {value} for {native[name]}")
        out["confounding"] = found
        if profile.draws and len(treatments) == 1:
            low, high, used = cluster_bootstrap_interval(sides.train, panel.spec.id_column, sides.target, treatments[0], ["u"], profile.draws, profile.seed_family)
            out["cluster_bootstrap"] = {"low": low, "high": high, "draws": used}
    return out


def run_study(spark: SparkSession, profile: Profile, path: str) -> list[dict]:
    """All planned trials, each on disk before the next one."""
    out = []
    with JsonLines(path) as sink:
        for k, (case, split) in enumerate(profile.cells):
            for seed in profile.seeds(k):
                record = run_trial(spark, case, split, seed, profile)
                sink.write(record)
                out.append(record)
    return out


_DOUBLE = T.DoubleType()
TRIAL = (
    T.StructType().add("case", T.StringType()).add("split", T.StringType()).add("seed", T.LongType()).add("status", T.StringType())
    .add("compression", _DOUBLE).add("selected_family", T.StringType()).add("oracle_r2", _DOUBLE).add("thin_states", T.ArrayType(T.StringType()))
    .add("paired_r2", T.StructType([T.StructField(c, _DOUBLE) for c in COMPARATORS]))
)
#: What a summary says of each figure, by suffix.
_MOMENTS = {"": F.avg, "_n": F.count, "_mc_se": lambda x: F.stddev_samp(x) / F.sqrt(F.count(x))}


def summarize_trials(spark: SparkSession, trials: DataFrame, profile: Profile) -> DataFrame:
    """Per planned cell: planned, successes, failures, mean figures and their Monte Carlo errors.

    Failures keep the planned denominator; a trial twice, or one that was not planned, is an error.
    """
    planned = spark.createDataFrame([(c, s, int(x)) for k, (c, s) in enumerate(profile.cells) for x in profile.seeds(k)], "case string, split string, seed long")
    if trials.groupBy("case", "split", "seed").count().where("count > 1").limit(1).count():
        raise ValueError("a trial is recorded twice")
    if trials.join(planned, ["case", "split", "seed"], "left_anti").limit(1).count():
        raise ValueError("a trial was not planned")
    ok = F.col("status") == "success"
    r2 = {c: F.when(ok, F.col(f"paired_r2.{c}")) for c in COMPARATORS}
    minus = {f"minus_{c}": r2["selected_macro"] - r2[c] for c in COMPARATORS[1:]}
    figures = r2 | minus | {"oracle_micro": F.when(ok, F.col("oracle_r2")), "compression": F.when(ok, F.col("compression"))}
    by = planned.join(trials, ["case", "split", "seed"], "left").groupBy("case", "split")
    families = F.sort_array(F.collect_list(F.when(ok, F.col("selected_family"))))  # at most the cell's planned trials
    return by.agg(
        F.count("*").alias("planned"),
        F.count_if(ok).alias("successes"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"),
        F.count_if(ok & (F.size("thin_states") > 0)).alias("thin_support"),
        *[f(x).alias(name + suffix) for name, x in figures.items() for suffix, f in _MOMENTS.items()],
        *[F.count_if(x > 0).alias(f"{name}_positive") for name, x in minus.items()],
        families.alias("families"),
    )


def audit_trials(records: list[dict], summary: list[dict], profile: Profile) -> dict:
    """Holds a summary against the raw records by plain arithmetic that shares nothing with the summary's own.

    Every planned trial must be there once and no other, and each count, mean and Monte Carlo error must come out again.
    """
    wanted = Counter((c, s, x) for k, (c, s) in enumerate(profile.cells) for x in profile.seeds(k))
    if Counter((r["case"], r["split"], r["seed"]) for r in records) != wanted:
        raise ValueError("the records are not the planned trials, each once")
    if sorted((r["case"], r["split"]) for r in summary) != sorted(profile.cells):
        raise ValueError("the summary's cells are not the planned ones")
    checks = 0
    for row in summary:
        mine = [r for r in records if (r["case"], r["split"]) == (row["case"], row["split"])]
        good = [r for r in mine if r["status"] == "success"]
        expected: dict = {"planned": len(mine), "successes": len(good), "failures": len(mine) - len(good), "thin_support": sum(bool(r["thin_states"]) for r in good)}
        expected["families"] = sorted(r["selected_family"] for r in good)
        series = {c: [r["paired_r2"][c] for r in good] for c in COMPARATORS}
        for c in COMPARATORS[1:]:
            series[f"minus_{c}"] = [None if r["paired_r2"][c] is None else r["paired_r2"]["selected_macro"] - r["paired_r2"][c] for r in good]
            expected[f"minus_{c}_positive"] = sum(x is not None and x > 0 for x in series[f"minus_{c}"])
        series |= {"oracle_micro": [r["oracle_r2"] for r in good], "compression": [r["compression"] for r in good]}
        for name, values in series.items():
            x = [v for v in values if v is not None]
            expected |= {name: statistics.fmean(x) if x else None, f"{name}_n": len(x), f"{name}_mc_se": statistics.stdev(x) / math.sqrt(len(x)) if len(x) > 1 else None}
        for name, value in expected.items():
            same = math.isclose(value, row[name], rel_tol=1e-10, abs_tol=1e-12) if isinstance(value, float) and row[name] is not None else value == row[name]
            if not same:
                raise ValueError(f"{row['case']}/{row['split']}: the summary says {name} = {row[name]}, the records {value}")
        checks += len(expected)
    return {"passed": True, "planned_trials": len(records), "failed_trials": sum(r["status"] != "success" for r in records), "checks": checks}


def export_study(spark: SparkSession, path: str, folder: str, profile: Profile) -> dict:
    """Reads recorded trials, audits their summary, and writes audit.json, results.csv and RESULTS.md; nothing if the audit fails."""
    records = [json.loads(line) for line in Path(path).read_text(encoding="utf-8").splitlines()]
    rows = [tuple(tuple((r.get(f.name) or {}).get(c) for c in COMPARATORS) if f.name == "paired_r2" else r.get(f.name) for f in TRIAL.fields) for r in records]
    summary = [r.asDict() for r in summarize_trials(spark, spark.createDataFrame(rows, TRIAL), profile).orderBy("case", "split").collect()]
    audit = audit_trials(records, summary, profile) | {"profile_sha256": profile.digest()}
    for row in summary:
        mine = [r["paired_r2"] for r in records if r["status"] == "success" and (r["case"], r["split"]) == (row["case"], row["split"])]
        interval = mean_interval([p["selected_macro"] - p["restricted_micro"] for p in mine], seed=profile.seed_family)
        for kind in ("t", "bootstrap"):
            row[f"{kind}_low"], row[f"{kind}_high"] = interval[f"{kind}_interval"] or (None, None)
        row["families"] = " ".join(f"{k}:{n}" for k, n in sorted(Counter(row["families"]).items()))
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "audit.json").write_text(strict_json(audit) + "\n", encoding="utf-8")
    with (out / "results.csv").open("w", newline="", encoding="utf-8") as stream:
        writer = csv.DictWriter(stream, list(summary[0]))
        writer.writeheader()
        writer.writerows(summary)
    (out / "RESULTS.md").write_text(report_markdown(summary), encoding="utf-8")
    return audit


def report_markdown(summary: list[dict]) -> str:
    """The summary as a Markdown table."""
    names = ["case", "split", "planned", "successes", *COMPARATORS, "minus_restricted_micro", "minus_restricted_micro_mc_se", "oracle_micro", "compression"]
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(text(r[n]) for n in names) + " |" for r in summary]) + "\n"
