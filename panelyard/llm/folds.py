"""Labelled training rows: never those of the held-out fold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _known(labels: DataFrame, label: str) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
    return known.where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y"))


def prior_shift(labels: DataFrame, label: str, per_class: int) -> float:
    """What to add to a logit that was fitted on training_rows(), so that it stands for the labels'
    own share of the classes: the sample takes at most per_class of each."""
    n = {r["y"]: r["n"] for r in _known(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = {y: min(k, per_class) for y, k in n.items()}
    return math.log(n[1] / taken[1]) - math.log(n[0] / taken[0]) if len(n) == 2 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most per_class labelled rows of each class outside the held-out
    fold, taken in order of a hash of the id. The bounded list of ids is broadcast."""
    known = _known(labels, label)
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # no other column can clash
    return texts.join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
