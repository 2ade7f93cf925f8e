"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of blanks and ASCII control spaces is
replaced by one space. One pass over the texts keeps a short row for each: the length of the
normalised text and a hash of it with the first ``PREFIX`` characters. Lengths that occur once
are done, then prefixes that occur once; the full texts are read and hashed only for rows
whose prefix hash is shared. Groups are counted with partial sums, and rows of hot keys are
dealt out or meet a broadcast list of at most ``HOT_KEYS`` keys, so a group of copies that
holds a third of all rows is never in one task.

Defined cases: a null text counts as empty. Of equal texts the row with the smallest doc_id
stays, a null id last; of repeated rows with that id one stays, so exactly one row of a group
is ``kept``. Extra columns are ignored unless they are to be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.llm.skew import hot_join, narrow_join
from leadline.session import materialise

PREFIX = 64
RESULT = ("doc_id", "keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, carry=()) -> DataFrame:
    """doc_id, keep_id, group_size and kept of every row, and the columns named in ``carry``.

    ``exact_duplicates(docs, carry=docs.columns[1:]).where("kept")`` is the table without
    copies. What is carried is stored with the short rows.
    """
    if set(carry) & set(RESULT):
        raise ValueError(f"{set(carry) & set(RESULT)} cannot be carried, the result has them")
    carried = F.struct(*carry) if carry else F.lit(0)
    whole = normalised(F.col("text"))
    rows = docs.select(
        "doc_id", carried.alias("_carry"), "text", F.octet_length(whole).alias("_bytes"),
        F.xxhash64(F.octet_length(whole), F.substring(whole, 1, PREFIX)).alias("_prefix"))

    # short rows of all texts, then what occurs once goes
    short = materialise(rows.drop("text"))
    total = short.count()
    lengths = short.groupBy("_bytes").agg(F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").select("_bytes")
    shared = narrow_join(short.select("_bytes", "_prefix"), materialise(lengths), "_bytes", total)
    keys = materialise(shared.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").select("_prefix"))
    alone = narrow_join(short, keys.withColumn("_shared", F.lit(True)), "_prefix", total, "left").where(
        F.col("_shared").isNull())

    # full texts of the rest; they move to their keys at every size, whatever fits in a broadcast
    full = hot_join(rows.select("doc_id", "_carry", "text", "_prefix"), keys, "_prefix", short,
                    "shuffle_hash").select(
        "doc_id", "_carry", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"))
    full = materialise(full)
    groups = full.groupBy("_hash").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")).alias("_stays"),
        F.count(F.lit(1)).alias("group_size")).select(
        "_hash", F.col("_stays.doc_id").alias("keep_id"), F.col("_stays._row").alias("_first"),
        "group_size")
    found = narrow_join(full, groups, "_hash", total)
    out = ["_carry.*"] if carry else []
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("_row") == F.col("_first")).alias("kept"), *out).unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias(
            "group_size"), F.lit(True).alias("kept"), *out))


ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, sha256(regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g'))
        AS text_sha256
    FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
    text_sha256
FROM lines WINDOW w AS (PARTITION BY text_sha256)
"""
