"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_unit


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, salt: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text, __y) of ``limit`` labelled documents at most, chosen by
    a hash of the id.  Null ids, texts and labels are left out; of several
    labels of one document the largest counts."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("__y")))
    n = known.count()
    # a hash threshold keeps about the limit; the top-k makes the bound strict
    chosen = (known.filter(hash_unit("__id", salt=salt) < 1.2 * limit / max(n, 1))
              .orderBy(hash_unit("__id", salt=salt), "__id").limit(limit))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__text IS NOT NULL")
    return rows.join(F.broadcast(chosen), "__id")
