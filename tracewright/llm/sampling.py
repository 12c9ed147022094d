"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import hashed_sample


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; null ids give null."""
    return F.crc32(doc_id.cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows_per_class: int) -> list[tuple[str, int]]:
    """(text, label) of at most rows_per_class rows of each of the labels 0 and 1, by least hash of the id.

    The labelled ids are chosen first, so only the chosen texts move.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null").where(allowed)
    picks = [hashed_sample(known.where(F.col("y") == v), rows_per_class, "doc_id") for v in (0, 1)]
    chosen = picks[0].unionByName(picks[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return sorted({(r["text"] or "", r["y"]) for r in rows.select("text", "y").collect()})


def auc(scores, truth) -> float:  # noqa: ANN001
    """Area under the ROC curve, ties at half."""
    import numpy as np

    s, y = np.asarray(scores, float), np.asarray(truth, bool)
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1, n0 = y.sum(), (~y).sum()
    return float((rank[y].sum() - n1 * (n1 + 1) / 2) / max(n1 * n0, 1))
