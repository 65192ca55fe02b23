"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def sql_of(module: str) -> str:
    return importlib.import_module(f"barloom.llm.{module}").SQL


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op9_suffix_dedup", sql_of("suffix_dedup"))
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.suffix_dedup import remove_repeats
    return remove_repeats(read(spark, sf_dir, "documents"))


@query("op6_jaccard_join", sql_of("jaccard_join"))
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.jaccard_join import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.context_mixing import score_texts
    return score_texts(read(spark, sf_dir, "documents"))


@query("op7_quality_discriminant")
def quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality import quality_scores
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_sainte_lague_mix", sql_of("mixing"))
def sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import mix
    return mix(read(spark, sf_dir, "documents"))


@query("op3_sanitisation")
def sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.sanitise import personal_data
    return personal_data(read(spark, sf_dir, "documents"))


@query("op2_string_tiling")
def string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.decontaminate import contaminated
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_main_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.main_text import main_text
    return main_text(read(spark, sf_dir, "pages"))


@query("op10_multi_index")
def multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.multi_index import neighbours
    return neighbours(read(spark, sf_dir, "embeddings"))


@query("op1_licence_scan")
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.licences import scan
    return scan(read(spark, sf_dir, "documents"))


@query("op13_metric_range_join", sql_of("metric_join"))
def metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.metric_join import near_vectors
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query("op12_structure_repair", sql_of("conversations"))
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.conversations import damage_and_repair
    return damage_and_repair(read(spark, sf_dir, "conversations"))


@query("op11_fp_tree_search", sql_of("lexical_tree"))
def fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.lexical_tree import best_documents
    return best_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
