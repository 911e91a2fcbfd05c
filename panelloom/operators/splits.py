"""Leakage-safe split plans as role columns.

A plan adds `outer_role` (train, test, purged) and `fold_1` .. `fold_k` (train, test, purged, dropped; null outside
the outer training rows). Outcomes are never looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.ranks import block_of, block_start, with_rank
from panelloom.runtime import Scratch, scratch_for

MODES = ("entity_holdout", "forward_time", "interpolation")
OUTER = "outer_role"
#: Entities whose ids may be permuted on the driver; above, `split_hash="md5"` ranks them on the executors.
MOST_PERMUTED = 5_000_000


def fold_column(k: int) -> str:
    return f"fold_{k}"


@dataclass(frozen=True)
class SplitPlan:
    frame: DataFrame
    mode: str
    folds: int
    fraction: float
    seed: int
    split_hash: str

    def coverage(self, id_column: str) -> DataFrame:
        """One row per split and role: rows, entities, first and last predictor and target times."""
        names = [OUTER, *(fold_column(k) for k in range(1, self.folds + 1))]
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col(n).alias("role")) for n in names]))
        rows = self.frame.select(F.col(f"`{id_column}`").alias("i"), "__panel_t", "__lead_time", pairs.alias("s")).where("s.role is not null")
        return rows.groupBy("s.split", "s.role").agg(
            F.count("*").alias("rows"),
            F.countDistinct("i").alias("entities"),
            F.min("__panel_t").alias("first_time"),
            F.max("__panel_t").alias("last_time"),
            F.min("__lead_time").alias("first_target_time"),
            F.max("__lead_time").alias("last_target_time"),
        )

    def overlap(self, id_column: str) -> DataFrame:
        """Entities with both training and test rows, by split."""
        names = [OUTER, *(fold_column(k) for k in range(1, self.folds + 1))]
        flags = [F.max((F.col(n) == r).cast("int")).alias(f"{n}_{r}") for n in names for r in ("train", "test")]
        by = self.frame.groupBy(F.col(f"`{id_column}`").alias("i")).agg(*flags)
        return by.agg(*[F.count_if((F.col(f"{n}_train") == 1) & (F.col(f"{n}_test") == 1)).alias(n) for n in names])

    def target_support(self, eligible: str) -> DataFrame:
        """Reserved and usable rows by split and role; membership does not depend on it."""
        names = [OUTER, *(fold_column(k) for k in range(1, self.folds + 1))]
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col(n).alias("role")) for n in names]))
        rows = self.frame.select(F.col(eligible).alias("ok"), pairs.alias("s")).where("s.role is not null")
        return rows.groupBy("s.split", "s.role").agg(F.count("*").alias("reserved"), F.count_if("ok").alias("usable"), F.count_if(~F.col("ok")).alias("ineligible"))

    def usable(self, eligible: str, split: str = OUTER, least: int = 2) -> DataFrame:
        """The split's eligible training and test rows; an error, not a new plan, if a side has fewer than `least`."""
        if dict(self.frame.dtypes).get(eligible) != "boolean":
            raise ValueError(f"eligibility column {eligible!r} must be boolean")
        if self.frame.where(F.col(eligible).isNull()).limit(1).count():
            raise ValueError(f"eligibility column {eligible!r} has missing values")
        have = {r["role"]: (r["usable"], r["reserved"]) for r in self.target_support(eligible).where(F.col("split") == split).collect()}
        for side in ("train", "test"):
            usable, reserved = have.get(side, (0, 0))
            if usable < least:
                raise ValueError(f"{split}: {usable} of {reserved} reserved {side} rows have a usable target, {least} are needed")
        return self.frame.where(F.col(split).isin("train", "test") & F.col(eligible))


def plan_splits(
    frame: DataFrame, id_column: str, mode: str = "entity_holdout", folds: int = 5, fraction: float = 0.2, seed: int = 0, split_hash: str = "permutation", tie: tuple[str, ...] = ()
) -> SplitPlan:
    """Plan an outer split and inner folds over a lagged frame (it has __panel_t and __lead_time)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not isinstance(folds, int) or isinstance(folds, bool) or folds < 2:
        raise ValueError("folds must be an integer of 2 or more")
    if not 0 < fraction < 1:
        raise ValueError("the holdout fraction must lie between 0 and 1")
    i = F.col(f"`{id_column}`")
    row = frame.agg(
        F.count("*").alias("n"),
        F.count_if(i.isNull() | F.col("__panel_t").isNull() | F.col("__lead_time").isNull()).alias("missing"),
        F.count_if(F.col("__lead_time") <= F.col("__panel_t")).alias("backward"),
    ).first()
    if row["n"] < 4:
        raise ValueError("a split plan needs four rows or more")
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows lack id, time or target time")
    if row["backward"]:
        raise ValueError(f"{row['backward']} rows have a target time that is not after their own time")
    scratch = scratch_for(frame.sparkSession, "splits")
    keyed = frame.withColumn("__id_text", i.cast("string"))
    if mode == "entity_holdout":
        out = _by_entity(keyed, folds, fraction, seed, split_hash, scratch)
    elif mode == "forward_time":
        out = _forward(keyed, folds, fraction, scratch)
    else:
        out = _interpolation(keyed, folds, fraction, tie)
    out = out.drop("__id_text")
    _require_sizes(out, folds)
    return SplitPlan(out, mode, folds, fraction, seed, split_hash if mode == "entity_holdout" else "none")


def _require_sizes(frame: DataFrame, folds: int) -> None:
    names = [OUTER, *(fold_column(k) for k in range(1, folds + 1))]
    row = frame.agg(*[F.count_if(F.col(n) == r).alias(f"{n}:{r}") for n in names for r in ("train", "test")]).first().asDict()
    if small := {k: v for k, v in row.items() if v < 2}:
        raise ValueError(f"each side of a split needs two rows or more: {small}")


def _entity_ranks(ids: DataFrame, seed: int, split_hash: str, scratch: Scratch) -> DataFrame:
    """(__id_text, rank): the entities in a random order that the seed fixes."""
    if split_hash == "md5":
        hashed = ids.withColumn("h", F.md5(F.concat("__id_text", F.lit(f"|{seed}"))))
        return with_rank(hashed, ["h", "__id_text"], scratch).drop("h")
    if split_hash != "permutation":
        raise ValueError("split_hash must be permutation or md5")
    if ids.limit(MOST_PERMUTED + 1).count() > MOST_PERMUTED:
        raise ValueError(f"more than {MOST_PERMUTED} entities: use split_hash='md5'")
    names = np.array(sorted(r[0] for r in ids.collect()), dtype=object)
    mixed = np.random.default_rng(seed).permutation(names)
    return ids.sparkSession.createDataFrame([(str(x), k) for k, x in enumerate(mixed)], "__id_text string, rank long")


def _by_entity(frame: DataFrame, folds: int, fraction: float, seed: int, split_hash: str, scratch: Scratch) -> DataFrame:
    ids = frame.select("__id_text").distinct()
    total = ids.count()
    if total < 2:
        raise ValueError("a split by entity needs two entities or more")
    held = min(max(1, math.ceil(total * fraction)), total - 1)
    outer = scratch.save(lambda: _entity_ranks(ids, seed, split_hash, scratch).select("__id_text", F.when(F.col("rank") < held, "test").otherwise("train").alias(OUTER)), "outer")
    left = total - held
    if left < folds + 1:
        raise ValueError(f"{left} training entities are too few for {folds} folds")
    train = outer.where(f"{OUTER} = 'train'").select("__id_text")
    inner = _entity_ranks(train, seed + 1, split_hash, scratch)
    inner = inner.select("__id_text", block_of(F.col("rank"), F.lit(left), folds).alias("b"))
    roles = [F.when(F.col("b") == k - 1, "test").when(F.col("b").isNotNull(), "train").alias(fold_column(k)) for k in range(1, folds + 1)]
    return frame.join(outer.join(inner, "__id_text", "left").select("__id_text", OUTER, *roles), "__id_text")


def _forward(frame: DataFrame, folds: int, fraction: float, scratch: Scratch) -> DataFrame:
    p, q = F.col("__panel_t"), F.col("__lead_time")
    times = with_rank(frame.select("__panel_t").distinct(), ["__panel_t"], scratch)
    total = times.count()
    at = total - max(1, math.ceil(total * fraction))
    if at < 1:
        raise ValueError("there is no time before the holdout")
    border = F.lit(times.where(F.col("rank") == at).first()["__panel_t"])
    out = frame.withColumn(OUTER, F.when(p >= border, "test").when(q < border, "train").otherwise("purged"))
    train = out.where(f"{OUTER} = 'train'")
    inner = with_rank(train.select("__panel_t").distinct(), ["__panel_t"], scratch)
    count = inner.count()
    # the first window ends at the first time that two rows or more lie before, targets included
    second = [r[0] for r in train.select("__lead_time").orderBy("__lead_time").limit(2).collect()]
    first = max(1, inner.where(F.col("__panel_t") <= F.lit(second[1])).count()) if len(second) == 2 else count
    if first > count - folds:
        raise ValueError(f"{count} training times leave no initial window before {folds} folds")
    starts = [first + block_start(b, count - first, folds) for b in range(folds)]
    value = {r["rank"]: r["__panel_t"] for r in inner.where(F.col("rank").isin(starts)).collect()}
    edges = [F.lit(value[s]) for s in starts]
    for k in range(1, folds + 1):
        begin, end = edges[k - 1], edges[k] if k < folds else None
        test = (p >= begin) if end is None else (p >= begin) & (p < end)
        role = F.when(test, "test").when(q < begin, "train").when(p < begin, "purged").otherwise("dropped")
        out = out.withColumn(fold_column(k), F.when(F.col(OUTER) == "train", role))
    return out


def _interpolation(frame: DataFrame, folds: int, fraction: float, tie: tuple[str, ...]) -> DataFrame:
    entity = Window.partitionBy("__id_text")
    order = entity.orderBy("__panel_t", *tie)
    out = frame.withColumn("__pos", F.row_number().over(order) - 1).withColumn("__len", F.count("*").over(entity))
    held = F.greatest(F.lit(1), F.ceil(F.col("__len") * fraction)).cast("long")
    start = F.greatest(F.lit(1), F.floor((F.col("__len") - held) / 2))
    short = out.agg(F.count_if(F.col("__len") < held + 3).alias("n")).first()["n"]
    if short:
        raise ValueError("some entities have too few rows for an interior holdout")
    test = (F.col("__pos") >= start) & (F.col("__pos") < start + held)
    out = _hull_roles(out, test, F.lit(True), OUTER, entity)
    _require_entity_training(out, OUTER, F.lit(True))
    # positions within the outer training rows, in time order
    train = F.col(OUTER) == "train"
    own = Window.partitionBy("__id_text", OUTER)
    out = out.withColumn("__ipos", F.row_number().over(own.orderBy("__panel_t", *tie)) - 1).withColumn("__ilen", F.count("*").over(own))
    inner = F.greatest(F.col("__ilen") - 2, F.lit(0))
    for k in range(1, folds + 1):
        size, extra = F.floor(inner / folds), inner % folds
        begin = (k - 1) * size + F.least(F.lit(k - 1), extra)
        length = size + (F.lit(k - 1) < extra).cast("long")
        middle = begin + F.floor(length / 2) + 1  # interior rows begin at position 1
        out = _hull_roles(out, train & (length > 0) & (F.col("__ipos") == middle), train, fold_column(k), entity)
        _require_entity_training(out, fold_column(k), train)
    return out.drop("__pos", "__len", "__ipos", "__ilen")


def _hull_roles(frame: DataFrame, test: Column, among: Column, name: str, entity: Window) -> DataFrame:
    """Test rows, and those rows of the entity purged whose interval meets the hull of the test rows' intervals."""
    first = F.min(F.when(test, F.col("__panel_t"))).over(entity)
    last = F.max(F.when(test, F.col("__lead_time"))).over(entity)
    meets = (F.col("__panel_t") <= last) & (F.col("__lead_time") >= first)
    return frame.withColumn(name, F.when(among, F.when(test, "test").when(F.coalesce(meets, F.lit(False)), "purged").otherwise("train")))


def _require_entity_training(frame: DataFrame, name: str, among: Column) -> None:
    lost = frame.where(among).groupBy("__id_text").agg(F.count_if(F.col(name) == "train").alias("n")).where("n = 0").limit(1).count()
    if lost:
        raise ValueError(f"{name}: an entity keeps no training row")


def row_modulo_folds(position: Column, folds: int) -> Column:
    """The test fold of a row by its position: for callers without a plan."""
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    return (position % folds).cast("int")
