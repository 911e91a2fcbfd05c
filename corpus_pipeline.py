"""A training-corpus pipeline of five stages, each an operator of panelloom.llm.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; run() writes it to the shared folder and
reads it as the next stage's docs. All but the last return the columns of documents, of which docs may have more.

Defined results: documents with a null id are dropped by the first stage: no later decision could name them. Rows of one
id are one document: it stays or goes as a whole, and each of its rows keeps its own text; of equal rows (id and text)
one stays. Null and empty texts go with the first stage. An empty table yields no rows. As a stage's docs are written, what
earlier stages of the same thread kept in the shared folder goes when it begins, and nothing else.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.language_mix import identify
from panelloom.llm.ngram_join import near_duplicates
from panelloom.llm.packing import pack
from panelloom.llm.string_tiling import contaminated
from panelloom.llm.substring_dedup import remove_repeated_words
from panelloom.runtime import Scratch, release_scratch, scratch_owner

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its main language has at least this proportion.
LEAST_PROPORTION = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def owning(stage: Stage) -> Stage:
    """The stage, its scratch folders being the pipeline's own: those of the stage before go first."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline-{threading.get_ident()}"
        release_scratch(owner)
        with scratch_owner(owner):
            return stage(spark, docs.select(*COLUMNS), sf_dir)

    return run_stage


@owning
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those with no main language go; lang becomes the inferred one."""
    named = docs.where("doc_id is not null").withColumn("known", F.col("lang")).drop("lang")
    judged = identify(named, lang_col="known", keep=("text", "source", "n_chars"))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_PROPORTION))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


@owning
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-grams of similarity 0.8 or more the document of the least id stays."""
    groups = near_duplicates(docs, n=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc_id", "text"]) if repeated else kept).select(*COLUMNS)


@owning
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has are removed; documents without any word left go. Texts that
    lose nothing stay as they are."""
    cut = remove_repeated_words(docs, keep=("text", "lang", "source"))
    left = cut.where("n_removed < n_words or n_words = 0").select(*COLUMNS[:1], "lang", "source", F.when(F.col("n_removed") > 0, F.col("left_over")).otherwise(F.col("text")).alias("text"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@owning
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in matching passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


@owning
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: one row per piece with its place."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: No stage of the middle can be said in SQL at this size: tests hold the run against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
