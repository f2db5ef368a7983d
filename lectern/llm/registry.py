"""Queries over the test tables, one per operator, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import chosenpath, decontaminate, licenses, lm, packing, quality, ranking, simhash, substrings, suffixes, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chosenpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicate_components(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm": op1_lm,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffixes": op8_suffixes,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
    "op11_ranking": op11_ranking,
    "op12_chosenpath": op12_chosenpath,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_licenses": licenses.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_suffixes": suffixes.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op10_quality": quality.ORACLE,
    "op11_ranking": ranking.ORACLE,
    "op12_chosenpath": chosenpath.ORACLE,
}
