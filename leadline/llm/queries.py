"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.llm import exactdup, infill, resampling
from leadline.llm.fingerprints import fingerprints
from leadline.llm.langid import languages
from leadline.llm.neardup import near_duplicates
from leadline.llm.packing import pack
from leadline.llm.pii import personal_data
from leadline.llm.quality import quality
from leadline.llm.seeds import contaminated
from leadline.llm.shards import shards
from leadline.llm.tokencount import token_counts
from leadline.llm.toxicity import toxicity

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package; a cluster installs it or ships it."""
    root, seen = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = seen.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        seen["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    return languages(table(spark, sf, "documents"))


@query
def op7_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards(table(spark, sf, "documents"))


@query
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(table(spark, sf, "documents"))


@query
def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(table(spark, sf, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    rows = infill.fill_in_middle(
        table(spark, sf, "documents").select("doc_id", "text"), verify=True)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), "restored_sha256")


@query
def op12_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of every row, unique ones too, is carried along; groups come by refinement."""
    digest = F.sha2(exactdup.normalised(F.col("text")).cast("binary"), 256)
    docs = table(spark, sf, "documents").select("doc_id", "text", digest.alias("text_sha256"))
    return exactdup.exact_duplicates(docs, carry=["text_sha256"])


@query
def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLES |= {"op11_fill_in_middle": infill.ORACLE_SQL, "op12_exact_duplicates": exactdup.ORACLE_SQL,
            "op13_importance_resampling": resampling.ORACLE_SQL}
