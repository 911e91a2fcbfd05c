"""The queries of this subpackage: name -> f(spark, folder of the tables), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.oracles import SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.language_mix import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.substring_dedup import remove_repeated_words

    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("left_over"), 256).alias("kept_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.page_text import extract

    out = extract(table(spark, sf_dir, "pages"), keep=("url",))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.importance import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.lit(True))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.license_rules import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.string_tiling import contaminated, worst_items

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return worst_items(found).select("doc_id", F.lit(True).alias("contaminated"), "item_id", "coverage", "n_tiles", "n_items")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.line_rules import clean_lines

    out = clean_lines(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept", "n_lines", "n_lines_removed", "n_chars_lost")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelloom.llm.suffix_dedup import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_license_scan": op7_license_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_line_rules": op9_line_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": pipeline,
}

