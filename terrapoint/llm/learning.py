"""What the two classifiers share: labels by document, and a bounded sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.llm.common import staged


def clean_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and y (0 or 1) of the rows to learn from; documents with contradicting labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(learn & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")


def sampled(docs: DataFrame, labels: DataFrame, per_class: int, label_name: str) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and y of up to `per_class` labelled documents of each class, the smallest by a hash of their id,
    staged; and the number of labelled rows of each class. The broadcast side holds 2 * per_class rows at most."""
    totals = {int(r["y"]): int(r["n"]) for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = labels.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return staged(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), label_name), totals


def calibrated(shares, y, weights, rounds: int = 4000):
    """(a, b) of the logistic curve a * share + b through the labelled shares, with a small penalty on a."""
    import numpy as np

    x = np.column_stack([np.asarray(shares, dtype=np.float64), np.ones(len(shares))])
    theta, v, m = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    total = weights.sum()
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        g = x.T @ (weights * (p - y)) / total + np.array([1e-4 * theta[0], 0.0])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return float(theta[0]), float(theta[1])
