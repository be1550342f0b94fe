"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs; all but the last return the columns of
documents. Null texts pass the filters and are packed as empty; empty tables
give empty results. Operators see ids and texts under names of their own, so
that further columns may be called anything; they come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, packing, simhash, suffixes
from sparkloom.llm import toxicity as tox
from sparkloom.llm.common import materialise
from sparkloom.llm.toxicity_fit import fit_tables

#: A document that scores at least this is rejected.
TOXIC = 0.3


def sheltered(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(docs) with docs' columns, all but doc_id and text called something that cannot clash meanwhile."""
    names = [c if c in ("doc_id", "text") else f"kept{i}" for i, c in enumerate(docs.columns)]
    return apply(docs.toDF(*names)).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier does not find toxic."""
    model = fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return sheltered(docs, lambda d: tox.score(d, model).where((F.col("_score") < TOXIC) | F.col("text").isNull()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies over five-word shingles."""
    return sheltered(docs, simhash.one_of_each)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that occur elsewhere too; a text that this empties goes."""
    marked = docs.withColumn("__cut", F.lit(False))
    cut = lambda d: suffixes.dedup(d).where("_n_removed = 0 OR _n_removed < _n_bytes").withColumn(d.columns[-1], F.col("_n_removed") > 0)
    out = sheltered(marked, cut)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return sheltered(docs, lambda d: decontaminate.annotate(d, bench).where("_n_hit = 0"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash, the classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
