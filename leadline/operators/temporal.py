"""Operators on ordered rows of an entity. They know no column names.

``part`` names the entity columns. Null is an entity of its own for the trailing, previous and
next operators, as in a window; for look-backs and as-of joins it matches nothing, as in a
join by equal keys. ``time`` names an integer column, ``width`` the chunk width (see ``chunks``).
A row without a time stays and sees nothing: what is added to it is null, whatever the width.
The trailing, previous and next operators expect one row per entity and time;
``one_per_instant`` gives that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.operators.chunks import CHUNK, OWN, chunk_of, offset_in_chunk, own_rows, spread
from leadline.operators.relational import null_safe_join

FROM_START = Window.unboundedPreceding


def one_per_instant(df: DataFrame, part, time: str, order) -> DataFrame:
    """Drop copies, then keep the smallest ``order`` per entity and time.

    Copies collapse before the shuffle (hash aggregate), and the row limit below is
    applied on the map side as well, so a pile of rows on one instant never moves.
    """
    w = Window.partitionBy(*part, time).orderBy(*[F.asc_nulls_last(c) for c in order])
    return df.distinct().withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# -- trailing frames ---------------------------------------------------------------

def trailing_first(df: DataFrame, part, time: str, cols, span: int, width: int) -> DataFrame:
    """Add ``first_<c>``: the earliest value within the last ``span`` units.

    A sliding frame looks at all its rows again for each row, which is fine for a short
    span. With a chunk narrower than the span the line counts as dense: the row wanted is
    then the first one from ``time - span`` on, found as-of on the negated time, so the
    work grows with the rows whatever the span holds.
    """
    if width < span:
        back = df.withColumn("_neg", F.lit(span) - F.col(time))
        points = df.select(*part, (-F.col(time)).alias("_neg"),
                           *[F.col(c).alias(f"first_{c}") for c in cols])
        firsts = [f"first_{c}" for c in cols]
        found = asof(back, points, part, "_neg", firsts, width, null_keys=True)
        return found.select(*df.columns, *[F.col(f"asof.{c}").alias(c) for c in firsts])
    w = (Window.partitionBy(*part, CHUNK).orderBy(time).rangeBetween(-span, 0))
    firsts = {f"first_{c}": F.when(F.col(time).isNotNull(), F.first(c).over(w)) for c in cols}
    return own_rows(spread(df, time, width, span).withColumns(firsts))


def trailing_span(df: DataFrame, part, time: str, span: int, width: int) -> DataFrame:
    """Add ``covered``: how much of the trailing frame has data."""
    seen = trailing_first(df, part, time, [time], span, width)
    return seen.withColumn("covered", F.col(time) - F.col(f"first_{time}")).drop(f"first_{time}")


# -- neighbours --------------------------------------------------------------------

def _neighbour(df, part, time, cols, width, forward: bool) -> DataFrame:
    """Add struct ``_near`` (time and cols) of the row before or after."""
    point = F.struct(time, *[c for c in cols if c != time])
    step, pick = (F.lead, F.min) if forward else (F.lag, F.max)
    rows = df.withColumn(CHUNK, chunk_of(time, width))

    inner = Window.partitionBy(*part, CHUNK).orderBy(time)
    rows = rows.withColumn("_near", step(point).over(inner))

    edges = (
        df.select(*part, chunk_of(time, width).alias(CHUNK), point.alias("_p"))
        .groupBy(*part, CHUNK).agg(pick("_p").alias("_edge"))
    )
    across = Window.partitionBy(*part).orderBy(CHUNK)
    edges = edges.select(*part, CHUNK, step("_edge").over(across).alias("_edge"))
    return (
        null_safe_join(rows, edges, [*part, CHUNK], "left")
        .withColumn("_near", F.coalesce("_near", "_edge"))
        .drop("_edge", CHUNK)
    )


def previous_or_self(df: DataFrame, part, time: str, cols, width: int) -> DataFrame:
    """Add ``prev_<c>``: the value of the row before, or the row's own if there is none."""
    near = _neighbour(df, part, time, cols, width, forward=False)
    own = F.col("_near").isNull()
    return near.withColumns({
        f"prev_{c}": F.when(own, F.col(c)).otherwise(F.col(f"_near.{c}")) for c in cols
    }).drop("_near")


def next_value(df: DataFrame, part, order: str, cols, width: int) -> DataFrame:
    """Add ``next_<c>``: the value of the row after, null at the end."""
    near = _neighbour(df, part, order, cols, width, forward=True)
    return near.withColumns({f"next_{c}": F.col(f"_near.{c}") for c in cols}).drop("_near")


def next_state(df: DataFrame, states: DataFrame, part, seq: str, gaps: bool = False,
               width: int = 1000) -> DataFrame:
    """Join every row of ``df`` with the state that follows it.

    Columns of ``states`` come out as ``next_<c>``. Without ``gaps`` the next state is
    ``seq + 1`` or nothing (left join); with ``gaps`` it is the next number that exists
    among ``states``, and rows without one are dropped.
    """
    renamed = states.select(*part, *[
        F.col(c).alias(f"next_{c}") for c in states.columns if c not in part
    ])
    nxt = f"next_{seq}"
    if not gaps:
        keyed = renamed.withColumn("_key", F.col(nxt))
        return (
            df.withColumn("_key", F.col(seq) + 1)
            .join(keyed, [*part, "_key"], "left").drop("_key")
        )
    numbers = states.select(*part, seq).where(F.col(seq).isNotNull()).distinct()
    follow = next_value(numbers, part, seq, [seq], width)
    return df.join(follow, [*part, seq]).join(renamed, [*part, nxt])


# -- as-of -------------------------------------------------------------------------

def lookback(df: DataFrame, part, time: str, cols, deltas, width: int) -> DataFrame:
    """Add struct ``back_<d>``: the entity's last row at or before ``time - d``.

    The struct holds ``time`` and ``cols``. Rows on the same instant go by the greatest
    ``cols``, in their order. One exchange and one sort serve all lags; what lies before
    the chunk and its halo comes from the chunk summary. Chunks narrower than the greatest
    lag are for dense lines: the shifted times of all lags then go through one as-of join. As
    in a join by equal keys, a row whose entity is null sees no row, whatever the width.
    """
    halo = max(deltas)
    if width < halo:
        return _lookback_dense(df, part, time, cols, deltas, width)
    point = F.when(F.col(time).isNotNull(), F.struct(time, *cols))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*part, time)])
    w = Window.partitionBy(*part, CHUNK).orderBy(time)
    rows = spread(df, time, width, halo).withColumns({
        f"back_{d}": F.max(point).over(w.rangeBetween(FROM_START, -d)) for d in deltas
    }).where(F.col(OWN)).drop(OWN)

    early = F.when(offset_in_chunk(time, width) < width - halo, F.col("_p"))
    summary = (
        df.select(*part, time, chunk_of(time, width).alias(CHUNK), point.alias("_p"))
        .groupBy(*part, CHUNK).agg(F.max("_p").alias("_all"), F.max(early).alias("_early"))
    )
    across = Window.partitionBy(*part).orderBy(CHUNK)
    carried = summary.select(*part, CHUNK, F.greatest(
        F.max("_all").over(across.rangeBetween(FROM_START, -2)),
        F.max("_early").over(across.rangeBetween(-1, -1)),
    ).alias("_carried"))
    # the window left the rows in the order of this join
    return (
        rows.hint("merge").join(carried, [*part, CHUNK], "left")
        .withColumns({f"back_{d}": F.when(known, F.coalesce(f"back_{d}", "_carried"))
                      for d in deltas})
        .drop("_carried", CHUNK)
    )


def _lookback_dense(df: DataFrame, part, time: str, cols, deltas, width: int) -> DataFrame:
    """``lookback`` by probes: every row asks once per lag, in one as-of join for all lags.

    The answers of a row are brought together by a number it got before it was repeated; only
    its first probe carries the row itself.
    """
    lags = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_lag"), (F.col(time) - d).alias("_t"))
        for i, d in enumerate(deltas)]))
    probes = df.withColumn("_id", F.monotonically_increasing_id()).select(
        *part, "_id", F.struct(*df.columns).alias("_own"), lags.alias("_ask")).select(
        *part, F.col("_ask._t").alias(time), "_id", F.col("_ask._lag").alias("_lag"),
        F.when(F.col("_ask._lag") == 0, F.col("_own")).alias("_own"))
    found = asof(probes, df.select(*part, time, *cols), part, time, cols, width)
    return found.groupBy("_id").agg(F.first("_own", ignorenulls=True).alias("_own"), *[
        F.max(F.when(F.col("_lag") == i, F.col("asof"))).alias(f"back_{d}")
        for i, d in enumerate(deltas)]).select("_own.*", *[f"back_{d}" for d in deltas])


def asof(left: DataFrame, right: DataFrame, keys, time: str, cols, width: int,
         null_keys: bool = False) -> DataFrame:
    """Add struct ``asof`` to ``left``: the last row of ``right`` at or before its time.

    Both sides go through one window per (key, chunk) as tagged rows; ties on the right
    go by the greatest ``cols``. A null key matches nothing, or with ``null_keys`` a null.
    """
    rest = [c for c in left.columns if c not in (*keys, time)]
    point = F.struct(time, *cols)
    point_type = right.select(point.alias("p")).schema["p"].dataType
    rest_type = left.select(F.struct(F.lit(1).alias("_x"), *rest).alias("r")).schema["r"].dataType
    probes = left.select(*keys, time, F.struct(F.lit(1).alias("_x"), *rest).alias("_row"),
                         F.lit(None).cast(point_type).alias("_p"))
    known = right.where(F.col(time).isNotNull())
    facts = (known if null_keys or not keys else known.dropna(subset=list(keys))).select(
        *keys, time, F.lit(None).cast(rest_type).alias("_row"), point.alias("_p"))
    both = probes.unionByName(facts).withColumn(CHUNK, chunk_of(time, width))

    w = Window.partitionBy(*keys, CHUNK).orderBy(time).rangeBetween(FROM_START, 0)
    seen = both.withColumn("asof", F.max("_p").over(w)).where(F.col("_row").isNotNull())

    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(FROM_START, -1)
    carried = (
        both.groupBy(*keys, CHUNK).agg(F.max("_p").alias("_last"))
        .select(*keys, CHUNK, F.max("_last").over(across).alias("_carried"))
    )
    return null_safe_join(seen, carried, [*keys, CHUNK], "left").select(
        *keys, time, *[F.col(f"_row.{c}").alias(c) for c in rest],
        F.coalesce("asof", "_carried").alias("asof"))


def last_known(df: DataFrame, part, time: str, cols, until=None) -> DataFrame:
    """The last row of every entity, at or before ``until`` when given."""
    rows = df if until is None else df.where(F.col(time) <= until)
    return (
        rows.groupBy(*part).agg(F.max(F.struct(time, *cols)).alias("_p"))
        .select(*part, "_p.*")
    )


# -- one fact per key against a time line --------------------------------------------

def attach_to_chunks(chunked: DataFrame, facts: DataFrame, keys) -> DataFrame:
    """Inner join of a time line that has its chunks with facts known per key.

    The join runs on (key, chunk), so one very long key is spread over many tasks. The
    facts reach each chunk through the list of chunks a key has, a distinct over narrow
    columns that collapses before its shuffle. That list is the side a task holds; the time
    line is neither sorted nor, by an estimate of its size, broadcast (see ``sync_frames``).
    """
    chunks = chunked.select(*keys, CHUNK).distinct()
    placed = chunks.join(facts, list(keys))
    return chunked.join(placed.hint("shuffle_hash"), [*keys, CHUNK])


def attach_to_series(series: DataFrame, facts: DataFrame, keys, time: str, width: int,
                     broadcast_rows: int = 0) -> DataFrame:
    """``attach_to_chunks`` for a time line that is not cut yet.

    With ``broadcast_rows`` the facts are counted, so give a stored table; up to that many
    are broadcast, and the time line is not shuffled at all.
    """
    if broadcast_rows and facts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return series.join(F.broadcast(facts), list(keys))
    marked = series.withColumn(CHUNK, chunk_of(time, width))
    return attach_to_chunks(marked, facts, keys).drop(CHUNK)


def nearest(series: DataFrame, targets: DataFrame, keys, time: str, at: str, cols,
            width: int, ties: str = "early", broadcast_rows: int = 0) -> DataFrame:
    """Add struct ``near`` (time and cols) to ``targets``: the row closest to ``at``.

    One target row per key; keys without any row are dropped. Ties in distance go to the
    earlier or the later row, then to the smallest ``cols``. A minimum over structs, so
    one row per key and task is shuffled.
    """
    sign = {"early": 1, "late": -1}[ties]
    ranked = F.struct(
        F.abs(F.col(time) - F.col(at)).alias("gap"),
        (F.col(time) * sign).alias("side"), *[F.col(c) for c in cols])
    found = (
        attach_to_series(series.select(*keys, time, *cols),
                         targets.where(F.col(at).isNotNull()).select(*keys, at),
                         keys, time, width, broadcast_rows)
        .groupBy(*keys).agg(F.min(ranked).alias("_best"))
    )
    return targets.join(found, list(keys)).select(*targets.columns, F.struct(
        (F.col("_best.side") * sign).alias(time),
        *[F.col(f"_best.{c}").alias(c) for c in cols]).alias("near"))


def nearest_time(series: DataFrame, targets: DataFrame, keys, time: str, at: str, width: int,
                 ties: str = "early", broadcast_rows: int = 0) -> DataFrame:
    """(keys, near_time): only the time of the closest row.

    Distance and side are packed into one integer, so this is a hash aggregate over the
    keys and the time alone; use it where the rows are read again around that time.
    """
    wrong = {"early": F.col(time) > F.col(at), "late": F.col(time) < F.col(at)}[ties]
    packed = F.abs(F.col(time) - F.col(at)) * 2 + wrong.cast("int")
    side = F.when(F.col("_p") % 2 == 0, -1 if ties == "early" else 1).otherwise(
        1 if ties == "early" else -1)
    return (
        attach_to_series(series.select(*keys, time),
                         targets.where(F.col(at).isNotNull()).select(*keys, at),
                         keys, time, width, broadcast_rows)
        .groupBy(*keys, at).agg(F.min(packed).alias("_p"))
        .select(*keys, (F.col(at) + side * F.expr("_p div 2")).alias("near_time"))
    )


def samples_before(series: DataFrame, moments: DataFrame, keys, time: str, at: str, cols, deltas,
                   width: int, broadcast_rows: int = 0) -> DataFrame:
    """(keys, near, back_<d>): the row at the instant ``at`` and the last one ``d`` earlier.

    ``moments`` has one instant per key. ``back_<d>`` means the same as in ``lookback``;
    ``near`` is the row of exactly that instant with the smallest ``cols``. Conditional
    extremes that start on the map side, no window over the time line; grouping by the
    keys alone lets the order of the join serve the aggregate.
    """
    point = F.struct(time, *cols)
    rows = attach_to_series(series.select(*keys, time, *cols),
                            moments.select(*keys, F.col(at).alias("_at")), keys, time, width,
                            broadcast_rows)
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col(time) == F.col("_at"), point)).alias("near"),
        *[F.max(F.when(F.col(time) <= F.col("_at") - d, point)).alias(f"back_{d}")
          for d in deltas])


# -- frames of two streams -----------------------------------------------------------

def sync_frames(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Rows of both streams at the same key and instant; ``keys`` include the time.

    A merge join on purpose: frames pack so well in files that their size there says nothing
    about a broadcast, which would pass a whole stream through the driver.
    """
    return a.hint("merge").join(b.hint("merge"), list(keys), how)


def resample(series: DataFrame, plays, entity, time: str, cols, steps: int,
             width: int) -> DataFrame:
    """Last known row of every entity at ``steps`` evenly spaced instants of its play.

    ``plays`` are the key columns that share a clock, ``entity`` the further columns
    that name one track. Entities not seen yet at an instant have no row there.

    A row holds until the next one of its track, so the steps it answers for follow from
    arithmetic; no as-of join is made. The clock of the play and the start of the next
    chunk come from the chunk summary, with the join that also places the rows.
    """
    keys = [*plays, *entity]
    marked = series.where(F.col(time).isNotNull()).withColumn(CHUNK, chunk_of(time, width))
    chunks = marked.groupBy(*keys, CHUNK).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"))
    clock = Window.partitionBy(*plays)
    chunks = chunks.select(
        *keys, CHUNK,
        F.lead("_first").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_after"),
        F.min("_first").over(clock).alias("_lo"), F.max("_last").over(clock).alias("_hi"))

    inside = Window.partitionBy(*keys, CHUNK).orderBy(time, *cols)
    rows = marked.withColumn("_next", F.lead(time).over(inside))
    # of rows on one instant the greatest is the last known one
    rows = rows.where(F.col("_next").isNull() | (F.col("_next") != F.col(time)))
    # in the order the window left
    rows = rows.hint("merge").join(chunks, [*keys, CHUNK]).withColumn(
        "_until", F.coalesce("_next", "_after"))

    last, span = steps - 1, F.col("_hi") - F.col("_lo")

    def step_of(at):
        return F.ceil((at - F.col("_lo")) * last / F.nullif(span.cast("double"), F.lit(0.0)))

    # one step too many on the left is dropped by the exact comparison below
    start = F.coalesce(F.greatest(step_of(F.col(time)) - 1, F.lit(0)), F.lit(0))
    stop = F.coalesce(F.least(step_of(F.col("_until")), F.lit(last)), F.lit(last))
    instant = F.col("_lo") + span * F.col("step") / F.lit(float(last))
    return (
        rows.withColumn("step", F.explode(F.sequence(start.cast("int"), stop.cast("int"))))
        .withColumn("instant", instant)
        .where(F.col("instant") >= F.col(time))
        .where(F.col("_until").isNull() | (F.col("instant") < F.col("_until")))
        .select(*keys, "step", "instant", *cols)
    )
