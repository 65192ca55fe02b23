"""From raw documents to a training mix: five stages, each on all the last one kept.

A stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and
returns the documents it keeps or has changed; the last adds what the mix takes of each.
``run`` writes every stage's result to the shared folder and reads it for the next.

Nulls, empty texts and extra columns are treated as each operator's docstring says. Rows
that repeat a doc_id are one document from the second stage on; rows without doc_id are
kept by it and go through the others like any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import buffers
from barloom.llm.decontaminate import clean_of
from barloom.llm.jaccard_join import near_duplicates
from barloom.llm.mixing import mix
from barloom.llm.quality import keep_good
from barloom.llm.sanitise import sanitised
from barloom.llm.stored import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every near-duplicate group."""
    docs = buffers.one_per_id(docs, "doc_id", "text")
    copies = near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    # a sort-merge join at every size: the copies grow with the documents
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced; n_chars follows the text."""
    out = sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``size``, ``target`` (of the source) and ``taken``."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(buffers.whole_text()))
    taken = (mix(docs.select(key.alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("__llm_key"))
             .agg(*[F.max(c).alias(c) for c in ("size", "target", "taken")]).where("taken > 0"))
    own = docs.drop("size", "target", "taken")
    return own.withColumn("__llm_key", key).join(taken, "__llm_key").drop("__llm_key")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

#: The stages run Python inside tasks, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: all stages in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}")
    return docs
