"""From documents to training sequences: each stage is written as Parquet and read by the next.

1. toxicity: documents that the pattern grammar predicts toxic go;
2. near_duplicates: of each class of texts with a Jaccard of 0.8 or more (five-word shingles) the
   document with the smallest id stays;
3. repeats: 100-byte strings that occur earlier are cut out of the texts;
4. decontamination: documents that hold a benchmark item go;
5. packing: the texts' token pieces in sequences of at most 4096.

All stages but the last return the columns of their docs. Null and empty texts pass the filters
(as one near-duplicate class) and are packed as an end id; empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm.decontamination import clean
from panelyard.llm.near_copies import one_of_each
from panelyard.llm.packing import best_fit_packing
from panelyard.llm.runtime import removed_since, tables_so_far, written
from panelyard.llm.suffix_dedup import without_repeats
from panelyard.llm.toxicity import without_toxic

#: SQL can't express the learned grammar, the fingerprints or the packing.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        removed_since(spark, mark)  # the stage's own tables, and its predecessor's result
    return docs
