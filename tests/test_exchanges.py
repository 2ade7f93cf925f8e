"""Plans: how often rows move, and ranges that follow the data; rows without a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadline.operators import motion, ranking, relational, temporal

WIDTHS = [7, 100, 100_000]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moving(df):
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def track(spark, tmp_path_factory):
    """A stored track with repeated rows and contradictory places at one instant."""
    rng = random.Random(4)
    rows = [(e, t, rng.uniform(0, 9), rng.uniform(0, 9)) for e in range(3) for t in range(0, 900, 30)]
    rows += [(e, t, x + rng.choice([0.0, 1.0]), y) for e, t, x, y in rows[::4]] + rows[::5]
    path = str(tmp_path_factory.mktemp("track") / "rows")
    spark.createDataFrame(rows, "e int, t long, x double, y double").write.parquet(path)
    return rows, spark.read.parquet(path)


def test_motion_moves_rows_once(track):
    _, df = track
    assert moving(motion.trailing_speed(df, ["e"], "t", "x", "y", 100, 300)) == 1
    # the second one moves a row per chunk
    assert moving(motion.path_length(df, ["e"], "t", "x", "y", 300)) == 2


@pytest.mark.parametrize("width", [120, 300, 100_000])
def test_smallest_place_of_an_instant_counts(track, width):
    rows, df = track
    got = motion.trailing_speed(df, ["e"], "t", "x", "y", 100, width).collect()
    want = {}
    for e, t, x, y in rows:
        want[e, t] = min(want.get((e, t), (99.0, 99.0)), (x, y))
    assert {(r.e, r.t): (r.x, r.y) for r in got} == want and len(got) == len(want)


def test_dense_look_back_reads_the_rows_the_same_for_any_number_of_lags(track):
    _, df = track

    def scans(deltas):
        return plan(temporal.lookback(df, ["e"], "t", ["x"], deltas, 50)).count("FileScan")

    assert scans([60]) == scans([60, 120, 180, 240, 300])


TIMES = [(1, 5, 1.0), (1, None, 2.0), (1, 300, 3.0), (None, None, 4.0), (2, None, 5.0), (2, None, 6.0)]


@pytest.mark.parametrize("width", WIDTHS)
def test_rows_without_a_time_stay_and_see_nothing(spark, width):
    df = spark.createDataFrame(TIMES, "e int, t long, x double").repartition(2)
    first = temporal.trailing_first(df, ["e"], "t", ["x"], 50, width).collect()
    span = temporal.trailing_span(df, ["e"], "t", 50, width).collect()
    back = temporal.lookback(df, ["e"], "t", ["x"], [0, 60], width).collect()
    for got in (first, span, back):
        assert sorted(r.x for r in got) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert {r.x: r.first_x for r in first} == {1.0: 1.0, 2.0: None, 3.0: 3.0, 4.0: None, 5.0: None, 6.0: None}
    assert all(r.covered is None for r in span if r.t is None)
    assert {r.x: r.back_60 and r.back_60.x for r in back} == {
        1.0: None, 2.0: None, 3.0: 1.0, 4.0: None, 5.0: None, 6.0: None}
    assert all(r.back_0 is None for r in back if r.t is None)


def test_motion_leaves_rows_without_a_time_out(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, None, 9.0, 9.0), (1, 50, 3.0, 4.0)],
                               "e int, t long, x double, y double")
    assert motion.path_length(df, ["e"], "t", "x", "y", 1000).first().path == pytest.approx(5)
    assert motion.trailing_speed(df, ["e"], "t", "x", "y", 100, 1000).count() == 2


def test_ranges_follow_the_rows(spark, monkeypatch):
    assert ranking.ranges_for(0) == ranking.FEWEST
    assert ranking.ranges_for(10 ** 9) == 5000 and ranking.ranges_for(10 ** 13) == ranking.MOST_RANGES
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    # most values lie in one narrow stretch
    df = spark.range(6000).select(F.when(F.col("id") < 5500, F.col("id") / 1e6).otherwise(
        F.col("id").cast("double")).alias("v"))
    cut = ranking.with_ranges(df, ["v"])
    sizes = [r["count"] for r in cut.groupBy("_range_v").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 250
    assert ranking.medians(df, ["v"])["v"] == pytest.approx(2999.5 / 1e6)


def test_folds_do_not_depend_on_the_cells(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("c"))
    one, two = ({r["id"]: r["fold"] for r in ranking.stratified_folds(
        df, "c", 5, F.col("id"), ["id"], cells=n).collect()} for n in (1, 70))
    assert one == two


def test_null_keys_are_dealt_out(spark):
    """Four fifths of the keys are null; no task of the join gets them all."""
    big = spark.range(8000).select(F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"), "id")
    small = spark.range(0, 8000, 10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = relational.spread_join(big, small, ["k"], "left", broadcast_rows=0)
        tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 8000 and max(tasks) < 8000 / 2
        assert got.where("v = 'x'").count() == 800
        for how, want in (("inner", 800), ("left_semi", 800), ("left_anti", 7200)):
            assert relational.spread_join(big, small, ["k"], how, broadcast_rows=0).count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert relational.fits_broadcast(df, 100) and not relational.fits_broadcast(df, 99)
    assert not relational.fits_broadcast(df, 100, 50_000) and relational.fits_broadcast(df.limit(0), 0, 0)
