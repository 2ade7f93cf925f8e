"""Operators on the plain test tables: events, orders, lineitem, customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.checks.registry import check
from leadline.functions import scalars as X
from leadline.operators import ranking, relational, summary, temporal

HOUR, DAY = 3_600_000, 86_400_000


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf):
    """Events with ``t``, milliseconds since 1970; the column has no time zone."""
    return table(spark, sf, "events").withColumn("t", F.expr(
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"))


EV = "WITH ev AS (SELECT *, epoch_us(ts) // 1000 AS t FROM events)"
# one row per user and millisecond: the smallest event number
EV1 = EV + """, one AS (
    SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) = 1)"""


def single_events(spark, sf):
    rows = events(spark, sf).select("user_id", "t", "event_id", "value")
    return temporal.one_per_instant(rows, ["user_id"], "t", ["event_id"])


# -- windows and as-of -------------------------------------------------------------

@check(EV1 + """
SELECT user_id, event_id, t, first_value(value) OVER w AS first_value FROM one
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)""")
def trailing_first_value(spark, sf):
    rows = temporal.trailing_first(
        single_events(spark, sf), ["user_id"], "t", ["value"], 6 * HOUR, HOUR)
    return rows.select("user_id", "event_id", "t", "first_value")


@check(EV1 + """
SELECT user_id, event_id, t - first_value(t) OVER w AS covered FROM one
WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)""")
def trailing_span(spark, sf):
    rows = temporal.trailing_span(single_events(spark, sf), ["user_id"], "t", 6 * HOUR, HOUR)
    return rows.select("user_id", "event_id", "covered")


@check(EV1 + """
SELECT user_id, event_id, lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY t) AS prev_value
FROM one""")
def lag_default(spark, sf):
    rows = temporal.previous_or_self(single_events(spark, sf), ["user_id"], "t", ["value"], DAY)
    return rows.select("user_id", "event_id", "prev_value")


@check(EV1 + """
SELECT user_id, event_id, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS next_value
FROM one""")
def lead_value(spark, sf):
    rows = temporal.next_value(single_events(spark, sf), ["user_id"], "t", ["value"], DAY)
    return rows.select("user_id", "event_id", "next_value")


@check(EV + """, probe AS (
    SELECT e.user_id, e.event_id, d.d, max({'t': p.t, 'v': p.value}) AS p
    FROM ev e, (SELECT unnest([3600000, 86400000]) AS d) d
    LEFT JOIN ev p ON p.user_id = e.user_id AND p.t <= e.t - d.d
    GROUP BY e.user_id, e.event_id, d.d)
SELECT user_id, event_id,
    CAST(max(p.t) FILTER (d = 3600000) AS DOUBLE) AS hour_t,
    max(p.v) FILTER (d = 3600000) AS hour_value,
    CAST(max(p.t) FILTER (d = 86400000) AS DOUBLE) AS day_t,
    max(p.v) FILTER (d = 86400000) AS day_value
FROM probe GROUP BY user_id, event_id""")
def asof_lookback(spark, sf):
    rows = temporal.lookback(
        events(spark, sf).select("user_id", "t", "event_id", "value"),
        ["user_id"], "t", ["value"], [HOUR, DAY], HOUR)
    hour, day = f"back_{HOUR}", f"back_{DAY}"
    return rows.select(
        "user_id", "event_id", F.col(f"{hour}.t").cast("double").alias("hour_t"),
        F.col(f"{hour}.value").alias("hour_value"),
        F.col(f"{day}.t").cast("double").alias("day_t"), F.col(f"{day}.value").alias("day_value"))


@check(EV + """, clicks AS (
    SELECT user_id, t, max(value) AS value FROM ev WHERE event_type = 'click' GROUP BY user_id, t)
SELECT v.user_id, v.event_id, CAST(c.t AS DOUBLE) AS click_t, c.value AS click_value
FROM ev v ASOF LEFT JOIN clicks c ON v.user_id = c.user_id AND v.t >= c.t
WHERE v.event_type = 'view'""")
def asof_two_tables(spark, sf):
    rows = events(spark, sf).select("user_id", "t", "event_id", "value", "event_type")
    views = rows.where("event_type = 'view'").select("user_id", "t", "event_id")
    clicks = rows.where("event_type = 'click'").select("user_id", "t", "value")
    return temporal.asof(views, clicks, ["user_id"], "t", ["value"], DAY).select(
        "user_id", "event_id", F.col("asof.t").cast("double").alias("click_t"),
        F.col("asof.value").alias("click_value"))


@check(EV + """
SELECT user_id, t, event_id, value FROM ev WHERE t <= 1705276800000
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1""")
def last_known(spark, sf):
    # 2024-01-15 00:00:00
    return temporal.last_known(
        events(spark, sf), ["user_id"], "t", ["event_id", "value"], F.lit(1705276800000))


# -- joins -------------------------------------------------------------------------

@check("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, o_orderstatus, o_totalprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def equi_join(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return relational.spread_join(lines, orders, ["l_orderkey"])


@check("""
SELECT o_orderkey, o_custkey, coalesce(c_name, '-') AS c_name, coalesce(c_nationkey, -1) AS nation
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def attach_lookup(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows = relational.attach_lookup(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), people,
        "o_custkey", "c_custkey")
    return rows.select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("-")).alias("c_name"),
                       F.coalesce("c_nationkey", F.lit(-1)).alias("nation"))


@check("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def semi_join(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return relational.keep_keys(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), returned, ["o_orderkey"])


@check("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def anti_join(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return relational.drop_keys(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), returned, ["o_orderkey"])


@check("""
SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderstatus = 'F'
    OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)""")
def exists_or(spark, sf):
    large = table(spark, sf, "lineitem").where("l_quantity >= 49").select(
        F.col("l_orderkey").alias("o_orderkey"))
    rows = relational.exists_flag(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), large,
        ["o_orderkey"], "large")
    return rows.where((F.col("o_orderstatus") == "F") | F.col("large")).drop("large")


# -- filters and aggregates ----------------------------------------------------------

@check("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def event_in_list(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").where(
        F.col("event_type").isin("click", "error"))


@check("""
SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events
WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 3""")
def min_sample(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'signup'").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return relational.min_sample(rows, "n", 3)


@check(EV + """
SELECT user_id, min(t) AS first_click FROM ev WHERE event_type = 'click' GROUP BY user_id""")
def first_event_time(spark, sf):
    return events(spark, sf).where("event_type = 'click'").groupBy("user_id").agg(
        F.min("t").alias("first_click"))


@check("""
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS max_click FROM events
GROUP BY user_id""")
def max_if(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        X.max_if(F.col("value"), F.col("event_type") == "click").alias("max_click"))


@check("""
SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.8), 6) AS p80 FROM events
GROUP BY user_id""")
def percentile_by_group(spark, sf):
    rows = ranking.percentile(table(spark, sf, "events"), "value", 0.8, ["user_id"])
    return rows.select("user_id", "n", F.round("value", 6).alias("p80"))


SHARES = [0.11, 0.25, 0.27, 0.5, 0.55, 0.6, 0.75]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@check("SELECT feature, share, round(v, 6) AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, unnest({SHARES}::DOUBLE[]) AS share, "
    f"unnest((SELECT quantile_cont({c}, {SHARES}) FROM lineitem)) AS v" for c in NUMBERS) + ")")
def quantile_table(spark, sf):
    rows = ranking.quantile_table(table(spark, sf, "lineitem"), NUMBERS, SHARES)
    return rows.select("feature", "share", F.round("value", 6).alias("value"))


@check("""
SELECT l_returnflag, count(DISTINCT (l_orderkey, l_suppkey)) AS pairs FROM lineitem
GROUP BY l_returnflag""")
def count_distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey", "l_suppkey").alias("pairs"))


@check("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1""")
def first_per_key(spark, sf):
    return relational.first_per(
        table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"),
        ["user_id", "event_type"], ["value", "event_id"])


@check("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) = 1""")
def top1_per_group(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return relational.top1(rows, ["l_suppkey"], [
        F.desc_nulls_last("l_extendedprice"), F.asc_nulls_last("l_orderkey"),
        F.asc_nulls_last("l_linenumber")])


@check("SELECT feature, round(m, 6) AS median, round(s, 6) AS std_samp, round(p, 6) AS std_pop "
       "FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, median({c}) AS m, stddev_samp({c}) AS s, "
           f"stddev_pop({c}) AS p FROM lineitem" for c in NUMBERS) + ")")
def median_std(spark, sf):
    rows = table(spark, sf, "lineitem").select(*NUMBERS)
    middle = ranking.quantile_table(rows, NUMBERS, [0.5]).select("feature", "value")
    return summary.spread_table(rows, NUMBERS).join(middle, "feature").select(
        "feature", *[F.round(c, 6).alias(n) for c, n in (
            ("value", "median"), ("std_samp", "std_samp"), ("std_pop", "std_pop"))])


@check("""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS w
    FROM events WHERE value IS NOT NULL),
placed AS (SELECT CAST(least(floor((value - lo) / w), 9) AS INTEGER) AS bin FROM events, b
    WHERE value IS NOT NULL)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS lo, round(lo + (i + 1) * w, 6) AS hi,
    (SELECT count(*) FROM placed WHERE placed.bin = i) AS n
FROM b, (SELECT unnest(range(10)) AS i)""")
def histogram_equal_bins(spark, sf):
    rows = summary.histogram(table(spark, sf, "events"), "value", 10)
    return rows.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@check("""
SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)
    / count(*) OVER () * 100, 6)::DOUBLE AS rank_pct
FROM events WHERE value IS NOT NULL""")
def rank_pct(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value").where("value IS NOT NULL")
    return ranking.rank_pct(rows, "value", "rank_pct").select(
        "event_id", F.round("rank_pct", 6).alias("rank_pct"))


# -- scalars -----------------------------------------------------------------------

@check("""
SELECT l_orderkey, l_linenumber, l_suppkey,
    round(sqrt((l_quantity - 3) * (l_quantity - 3) + (l_discount - 4) * (l_discount - 4)), 6) AS d
FROM lineitem""")
def distance_2d(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.round(X.distance(F.col("l_quantity"), F.col("l_discount"), (3.0, 4.0)), 6).alias("d"))


@check("""
SELECT l_orderkey, l_linenumber, l_suppkey, round(power(l_quantity, 2), 6) AS squared,
    round(abs(l_discount - l_tax), 6) AS gap, round(sqrt(l_extendedprice), 6) AS root,
    greatest(l_quantity, 10.0::DOUBLE) AS at_least
FROM lineitem""")
def math_scalars(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.round(F.pow("l_quantity", F.lit(2.0)), 6).alias("squared"),
        F.round(F.abs(F.col("l_discount") - F.col("l_tax")), 6).alias("gap"),
        F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.greatest("l_quantity", F.lit(10.0)).alias("at_least"))


@check("""
SELECT l_orderkey, l_linenumber, l_suppkey, round(l_tax / nullif(l_discount, 0), 6) AS ratio
FROM lineitem""")
def safe_divide(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.round(X.safe_divide(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


@check(EV + "SELECT event_id, t / 1000::DOUBLE AS s FROM ev")
def ms_to_s(spark, sf):
    return events(spark, sf).select("event_id", X.seconds(F.col("t")).alias("s"))


@check("""
SELECT l_orderkey, l_linenumber, l_suppkey,
    CASE WHEN length(CAST(l_partkey AS VARCHAR)) < 3 THEN lpad(CAST(l_partkey AS VARCHAR), 3, '0')
        ELSE CAST(l_partkey AS VARCHAR) END AS padded
FROM lineitem""")
def zfill3(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        X.pad3(F.col("l_partkey").cast("string")).alias("padded"))


@check("""
SELECT event_id, array_to_string(list_transform(
    string_split(replace(event_type || '_of_user_' || user_id, '_', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS label
FROM events""")
def title_label(spark, sf):
    return table(spark, sf, "events").select("event_id", X.title_label(F.concat(
        "event_type", F.lit("_of_user_"), F.col("user_id").cast("string"))).alias("label"))
