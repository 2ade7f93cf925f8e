"""Cutting long time lines into chunks of fixed width.

A window per entity puts all rows of that entity into one task. Here windows run per
(entity, chunk): a chunk covers ``width`` units of integer time, so with one row per
entity and instant it cannot hold more than ``width`` rows, however long the entity's
time line is. Two things carry what a window needs across the cut:

* rows near the end of a chunk are also sent to the following one (``halo``), which
  serves frames of bounded length;
* a summary with one row per (entity, chunk), pre-aggregated before its shuffle,
  serves frames without a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"


def chunk_of(time: str, width: int) -> Column:
    """Number of the chunk an integer time falls in, negative times included."""
    return F.expr(f"(`{time}` - pmod(`{time}`, {width}L)) div {width}L")


def offset_in_chunk(time: str, width: int) -> Column:
    return F.expr(f"pmod(`{time}`, {width}L)")


def spread(df: DataFrame, time: str, width: int, halo: int) -> DataFrame:
    """Add the chunk, and a copy of the last ``halo`` units for the next chunk.

    ``_own`` is true for a row in its own chunk; drop the others after the window. Rows
    without a time stay, in a chunk that is null.
    """
    if halo > width:
        raise ValueError(f"chunk width {width} is shorter than the look-back {halo}")
    own = chunk_of(time, width)
    late = offset_in_chunk(time, width) >= F.lit(width - halo)
    homes = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(CHUNK, F.explode(homes)).withColumn(
        OWN, F.col(CHUNK).eqNullSafe(own))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(OWN, CHUNK)
