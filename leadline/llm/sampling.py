"""Bounded samples of labelled documents, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int,
                    per_class: int, max_bytes: int) -> DataFrame:
    """At most ``per_class`` labelled documents of each class 0 and 1, with their whole texts.

    Only rows whose id has another remainder than ``held_out`` are used. Ids are chosen by a
    hash, so the choice does not depend on the layout of the data; ids labelled in two ways
    are left out, and texts over ``max_bytes`` are not learnt from. ``per_class`` and
    ``max_bytes`` bound what the sample can weigh. Returns doc_id, text, y, rank (0-based).
    """
    marked = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()
                           & (remainder("doc_id", parts) != held_out))
              .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_other"))
              .where("y = _other").select("doc_id", "y"))
    spread = F.xxhash64("doc_id", F.lit(label))
    chosen = None
    for y in (0, 1):
        part = (marked.where(F.col("y") == y).withColumn("_at", spread)
                .orderBy("_at", "doc_id").limit(per_class))
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id"), F.col("text")).where(
        F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # the right side holds 2 * per_class ids at most
    return (texts.join(F.broadcast(chosen), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "y", "_at"))
