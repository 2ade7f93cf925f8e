import pytest
from pyspark.sql import functions as F

from leadline.operators import relational


@pytest.fixture(scope="module")
def sides(spark):
    """One key holds most rows of the left side; some keys are null or unmatched."""
    left = [(7, i) for i in range(300)] + [(i, i) for i in range(60)] + [(None, 1), (None, 2)]
    right = [(i, f"v{i}") for i in range(0, 40)] + [(7, "twice"), (None, "null")]
    return (spark.createDataFrame(left, "k int, a int").repartition(3),
            spark.createDataFrame(right, "k int, b string"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(sides, how):
    big, small = sides
    want = sorted(map(str, big.join(small, ["k"], how).collect()))
    for rows in (0, 1000):
        got = relational.spread_join(big, small, ["k"], how, broadcast_rows=rows, salts=5)
        assert sorted(map(str, got.collect())) == want


def test_salted_join_spreads_the_hot_key(sides):
    big, small = sides
    joined = relational.spread_join(big, small, ["k"], broadcast_rows=0, salts=5)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_lookup_keeps_every_row(sides):
    big, small = sides
    table = small.where("b <> 'twice'").withColumnRenamed("k", "id")
    got = relational.attach_lookup(big, table, "k", "id")
    assert got.columns == ["k", "a", "b"] and got.count() == big.count()
    assert got.where("k is null and b is not null").count() == 0


def test_semi_anti_and_flag_partition_the_rows(sides):
    big, small = sides
    kept = relational.keep_keys(big, small, ["k"]).count()
    dropped = relational.drop_keys(big, small, ["k"])
    assert kept + dropped.count() == big.count()
    assert dropped.where("k is null").count() == 2
    flagged = relational.exists_flag(big, small, ["k"], "f")
    assert flagged.where("f").count() == kept and flagged.count() == big.count()


def test_first_per_is_independent_of_partitioning(spark):
    rows = [(i % 3, (i * 7) % 5, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    want = {k: min((o, v) for kk, o, v in rows if kk == k) for k in range(3)}
    for n in (1, 4, 9):
        got = relational.first_per(df.repartition(n), ["k"], ["o", "v"]).collect()
        assert {r.k: (r.o, r.v) for r in got} == want


def test_first_per_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (1, 5)], "k int, o int")
    assert relational.first_per(df, ["k"], ["o"]).first().o == 5


def test_overlay_drops_rows_without_label(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, label string")
    labels = spark.createDataFrame([(1, "a"), (2, None)], "k int, label string")
    assert [tuple(r) for r in relational.overlay_labels(df, labels, ["k"], "label").collect()] == [
        (1, "a")]


def test_small_filters(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "v double, s string")
    assert relational.plausible(df, {"v": (2, None)}).count() == 2
    assert relational.plausible(df, {"v": (1.5, 2)}).count() == 1
    assert relational.exclude(df, "s", ["a", "c"]).first().s == "b"
    assert {k: v.count() for k, v in relational.split_by(df, "s", ["a", "z"]).items()} == {
        "a": 1, "z": 0}
    assert relational.with_constants(df, speed=31.5).agg(F.min("speed")).first()[0] == 31.5
