"""Bounded training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import pick


def fold(column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % of


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of about `max_rows` labelled documents outside the held-out fold, chosen by hash.

    Ids whose label is null or contradictory are left out. The chosen labels are broadcast: there are about max_rows of them whatever the input."""
    known = (pick(labels, doc_id="doc_id", label=label).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", F.col("label").cast("int").alias("label")))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("training"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
