"""Operators and pipelines on the tracking fixture.

Oracles use other forms than the plans: ASOF joins for look-backs, row numbers for the
nearest frame, unbounded windows instead of chunks. Frame-level results are compared as
digests per play (counts and rounded sums over all of its frames).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.checks import fixture
from leadline.checks.fixture import script
from leadline.checks.registry import check
from leadline.functions import codes, scalars, states
from leadline.functions.codes import FRAME, PLAY
from leadline.operators import motion, relational, temporal
from leadline.plans import balls_in_play, leads, moments, people, pickoffs, steals
from leadline.plans.moments import CHUNK_MS, XY
from leadline.session import materialise, scratch_path
from leadline.sources.tracking import (
    CANONICAL, canonicalise, load_games, load_tracking, write_partitioned, write_tracking,
)

# -- oracle tables -----------------------------------------------------------------

B1 = "45 * sqrt(2)"


def _dist(x, y, bx, by):
    return f"sqrt(({x} - ({bx})) * ({x} - ({bx})) + ({y} - ({by})) * ({y} - ({by})))"


FIRST_ONLY = ("first_baserunner IS NOT NULL AND second_baserunner IS NULL "
              "AND third_baserunner IS NULL")


def _kin(otherwise):
    v = ", ".join(
        f"CASE WHEN t{i + 1} IS NOT NULL AND t{i + 1} <> t{i} THEN "
        f"(l{i} - l{i + 1}) / ((t{i} - t{i + 1}) / 1000::DOUBLE) ELSE {otherwise} END AS v{i}"
        for i in range(3))
    return f"""
    SELECT *, (a0 - a1) / nullif((t0 - t1) / 1000::DOUBLE, 0) AS j0 FROM (
        SELECT *, (v0 - v1) / nullif((t0 - t1) / 1000::DOUBLE, 0) AS a0,
            (v1 - v2) / nullif((t1 - t2) / 1000::DOUBLE, 0) AS a1
        FROM (SELECT *, {v} FROM samples))"""


def _kin_mid(table):
    return f"""
        SELECT *, (a0 - a1) / nullif((t0 + t1) / 2.0::DOUBLE - (t1 + t2) / 2.0::DOUBLE, 0) * 1000 AS j0
        FROM (
            SELECT *,
                (v0 - v1) / nullif((t0 + t1) / 2.0::DOUBLE - (t1 + t2) / 2.0::DOUBLE, 0) * 1000 AS a0,
                (v1 - v2) / nullif((t1 + t2) / 2.0::DOUBLE - (t2 + t3) / 2.0::DOUBLE, 0) * 1000 AS a1
            FROM (SELECT *, (l0 - l1) / nullif(t0 - t1, 0) * 1000 AS v0,
                (l1 - l2) / nullif(t1 - t2, 0) * 1000 AS v1,
                (l2 - l3) / nullif(t2 - t3, 0) * 1000 AS v2
                FROM {table} WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL))"""


def _moment(kin, at, ties, extra="release", need=""):
    order = {"early": "ASC", "late": "DESC"}[ties]
    return f"""
    SELECT k.*, {at} AS at FROM {kin} k JOIN {extra} USING (game_str, play_id) {need}
    QUALIFY row_number() OVER (PARTITION BY k.game_str, k.play_id
        ORDER BY abs(k.t0 - ({at})), k.t0 {order}, k.x, k.y) = 1"""


MORE = {
    "release": (("pp", "bp"), f"""
        SELECT b.game_str, b.play_id, min(b.ts) AS rel FROM bp b
        JOIN pp p ON b.game_str = p.game_str AND b.play_id = p.play_id AND b.ts = p.ts
        WHERE p.pos = 1 AND {_dist('b.bx', 'b.b_y', 'p.x', 'p.y')} >= 1 GROUP BY ALL"""),
    "runner": (("pp",), "SELECT game_str, play_id, ts, x, y FROM pp WHERE pos = 11"),
    "back": (("runner",), """
        SELECT r.game_str, r.play_id, r.ts AS t0, r.x, r.y, a.ts AS t1, a.x AS x1, a.y AS y1,
            b.ts AS t2, b.x AS x2, b.y AS y2, c.ts AS t3, c.x AS x3, c.y AS y3
        FROM runner r
        ASOF LEFT JOIN runner a
            ON r.game_str = a.game_str AND r.play_id = a.play_id AND r.ts - 100 >= a.ts
        ASOF LEFT JOIN runner b
            ON r.game_str = b.game_str AND r.play_id = b.play_id AND r.ts - 200 >= b.ts
        ASOF LEFT JOIN runner c
            ON r.game_str = c.game_str AND r.play_id = c.play_id AND r.ts - 300 >= c.ts"""),
    "samples": (("back",), "SELECT *, " + ", ".join(
        f"{_dist('x' + s, 'y' + s, B1, B1)} AS l{i}"
        for i, s in enumerate(["", "1", "2", "3"])) + " FROM back"),
    "kin": (("samples",), _kin("NULL")),
    "kin_zero": (("samples",), _kin("0")),
    "kin_mid": (("samples",), _kin_mid("samples")),
    "who": (("gi",), """
        SELECT DISTINCT game_str, play_per_game AS play_id, s.pos, s.id AS runner_id FROM (
            SELECT game_str, play_per_game, unnest([{'pos': 11, 'id': first_baserunner},
                {'pos': 12, 'id': second_baserunner}, {'pos': 13, 'id': third_baserunner}]) AS s
            FROM gi) WHERE s.id IS NOT NULL"""),
    "tops": (("pp", "who"), f"""
        SELECT game_str, play_id, pos, runner_id, sum({_dist('x', 'y', 'px', 'py')}) AS path,
            max(CASE WHEN ts - ft >= 750 THEN {_dist('x', 'y', 'fx', 'fy')} / nullif(ts - ft, 0)
                * 1000 END) AS top
        FROM (
            SELECT *, first_value(x) OVER f AS fx, first_value(y) OVER f AS fy,
                first_value(ts) OVER f AS ft, lag(x, 1, x) OVER p AS px, lag(y, 1, y) OVER p AS py
            FROM pp JOIN who USING (game_str, play_id, pos)
            WINDOW f AS (PARTITION BY game_str, play_id, runner_id ORDER BY ts
                    RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW),
                p AS (PARTITION BY game_str, play_id, runner_id ORDER BY ts))
        GROUP BY game_str, play_id, pos, runner_id"""),
    "speeds": (("tops",), """
        SELECT runner_id, quantile_cont(top, 0.8) AS sprint_speed, count(*) AS n FROM tops
        WHERE path >= 45 AND top > 20 AND top < 40 GROUP BY runner_id HAVING count(*) >= 3"""),
    "throws": (("ge", "gi"), """
        SELECT DISTINCT e.game_str, e.play_id, g.catcher AS catcher_id,
            (tag - caught) / 1000::DOUBLE AS pop
        FROM ge e JOIN gi g ON g.game_str = e.game_str AND g.play_per_game = e.play_per_game
        JOIN (SELECT game_str, play_id, min(ts) AS caught FROM ge WHERE code = 2 AND pos = 2
            GROUP BY ALL) c ON c.game_str = e.game_str AND c.play_id = e.play_id
        JOIN (SELECT game_str, play_id, min(ts) AS tag FROM ge WHERE code = 2 AND pos IN (4, 6)
            GROUP BY ALL) t ON t.game_str = e.game_str AND t.play_id = e.play_id
        WHERE e.code = 3 AND g.catcher IS NOT NULL AND tag > caught"""),
    "pops": (("throws",), """
        SELECT catcher_id, avg(pop) AS average_pop_time,
            count(DISTINCT (game_str, play_id)) AS total_throws
        FROM throws WHERE pop BETWEEN 1.6 AND 2.5 GROUP BY catcher_id
        HAVING count(DISTINCT (game_str, play_id)) >= 3"""),
    "tries": (("ge", "gi"), f"""
        SELECT e.game_str, e.play_id, min(g.first_baserunner) AS runner_id
        FROM ge e JOIN gi g ON g.game_str = e.game_str AND g.play_per_game = e.play_id
        WHERE e.code = 6 AND {FIRST_ONLY}
            AND (e.game_str, e.play_id) NOT IN (SELECT (game_str, play_id) FROM ge WHERE code = 1)
        GROUP BY ALL"""),
    "judged": (("tries",), """
        SELECT t.*, CAST(CASE WHEN n.play_per_game IS NULL THEN -1
            WHEN coalesce(n.first_baserunner, n.second_baserunner, n.third_baserunner) IS NOT NULL
            THEN 0 ELSE 1 END AS INTEGER) AS pickoff_result
        FROM tries t LEFT JOIN gi n
            ON n.game_str = t.game_str AND n.play_per_game = t.play_id + 1"""),
    "at_pickoff": (("kin", "release"), _moment("kin", "rel - 725", "early")),
    "at_pitch": (("kin", "release"), _moment("kin", "rel - 1250", "late")),
    "at_contact": (("kin_zero", "release"), _moment("kin_zero", "rel - 1250", "early")),
    "runs": (("ge", "gi", "pp", "bp"), f"""
        SELECT DISTINCT g.game_str, g.play_per_game, e.play_id, g.first_baserunner AS runner_id,
            g.catcher AS catcher_id, g.top_bottom_inning AS half
        FROM gi g JOIN ge e ON e.game_str = g.game_str AND e.play_per_game = g.play_per_game
        WHERE {FIRST_ONLY} AND g.catcher IS NOT NULL
            AND (e.game_str, e.play_id) IN (SELECT (game_str, play_id) FROM ge WHERE code = 1)
            AND (e.game_str, e.play_id) NOT IN
                (SELECT (game_str, play_id) FROM ge WHERE code IN (4, 6, 10))
            AND (e.game_str, e.play_id) NOT IN (SELECT (game_str, play_id) FROM bp WHERE b_y < -5)
            AND (e.game_str, e.play_id) IN (SELECT (game_str, play_id) FROM pp
                WHERE pos = 11 AND {_dist('x', 'y', '0', '120')} < 45)"""),
    "ended": (("runs",), """
        SELECT DISTINCT r.game_str, r.play_per_game, r.play_id, r.runner_id, r.catcher_id,
            CAST(CASE WHEN coalesce(n.second_baserunner, n.third_baserunner) IS NOT NULL
                THEN 0 ELSE 1 END AS INTEGER) AS outcome
        FROM runs r JOIN gi n ON n.game_str = r.game_str AND n.play_per_game = (
            SELECT min(m.play_per_game) FROM gi m
            WHERE m.game_str = r.game_str AND m.play_per_game > r.play_per_game)
        WHERE n.first_baserunner IS NULL AND (r.half = n.top_bottom_inning OR (
            r.half <> n.top_bottom_inning AND (r.game_str, r.play_id) IN
                (SELECT (game_str, play_id) FROM ge WHERE code = 3)))"""),
    "at_bats": (("gi", "ge"), f"""
        SELECT *, row_number() OVER (PARTITION BY game_str, top_bottom_inning, at_bat, struck
            ORDER BY play_per_game DESC, batter, first_baserunner, second_baserunner,
                third_baserunner) AS i
        FROM (
            SELECT *, FALSE AS struck FROM gi
            WHERE (game_str, play_per_game) IN (SELECT (game_str, play_id) FROM ge)
            UNION ALL SELECT *, TRUE FROM gi
            WHERE (game_str, play_per_game) IN (SELECT (game_str, play_id) FROM ge WHERE code = 4)
                AND {FIRST_ONLY})
        WHERE at_bat IS NOT NULL"""),
    "bip": (("at_bats",), """
        SELECT a.game_str, a.play_per_game AS play_id, a.top_bottom_inning, a.at_bat,
            a.play_per_game, a.batter, a.first_baserunner, n.play_per_game AS next_play,
            n.first_baserunner AS next_first, n.second_baserunner AS next_second,
            n.third_baserunner AS next_third
        FROM at_bats a JOIN at_bats n ON n.game_str = a.game_str
            AND n.top_bottom_inning = a.top_bottom_inning AND n.at_bat = a.at_bat + 1
        WHERE a.struck AND a.i = 1 AND NOT n.struck AND n.i = 1"""),
    "told": (("bip",), """
        SELECT *, (CASE WHEN '1B' IN (batter_result, baserunner_result) THEN '1' ELSE '0' END)
            || (CASE WHEN '2B' IN (batter_result, baserunner_result) THEN '1' ELSE '0' END)
            || (CASE WHEN '3B' IN (batter_result, baserunner_result) THEN '1' ELSE '0' END)
            AS base_state
        FROM (SELECT * EXCLUDE (next_play, next_first, next_second, next_third),
            CASE batter WHEN next_first THEN '1B' WHEN next_second THEN '2B'
                WHEN next_third THEN '3B' ELSE 'Out' END AS batter_result,
            CASE first_baserunner WHEN next_first THEN '1B' WHEN next_second THEN '2B'
                WHEN next_third THEN '3B' ELSE 'Inconclusive' END AS baserunner_result
            FROM bip)"""),
    "ends": (("ge", "pp"), """
        SELECT e.game_str, e.play_id, p.pos, p.x, p.y FROM ge e
        JOIN pp p ON p.game_str = e.game_str AND p.play_id = e.play_id AND p.ts = e.ts
        WHERE e.code = 5 AND p.pos IN (10, 11)
        QUALIFY row_number() OVER (PARTITION BY e.game_str, e.play_id, p.pos
            ORDER BY e.ts DESC, p.x, p.y) = 1"""),
    "valid": (("told", "ends"), f"""
        SELECT t.*, b.x AS batter_end_x, b.y AS batter_end_y, r.x AS runner_end_x,
            r.y AS runner_end_y
        FROM told t
        LEFT JOIN ends b ON b.game_str = t.game_str AND b.play_id = t.play_id AND b.pos = 10
        LEFT JOIN ends r ON r.game_str = t.game_str AND r.play_id = t.play_id AND r.pos = 11
            AND t.baserunner_result = '1B'
        WHERE batter_result = 'Out'
            OR (batter_result = '1B' AND {_dist('b.x', 'b.y', B1, B1)} <= 10)
            OR (batter_result = '2B' AND {_dist('b.x', 'b.y', '0', '120')} <= 10)
            OR (batter_result = '3B' AND {_dist('b.x', 'b.y', f'-{B1}', B1)} <= 10)"""),
    "hits": (("valid", "at_contact", "speeds"), """
        SELECT v.*, k.l0 AS lead_distance, k.v0 AS velocity, k.a0 AS acceleration, k.j0 AS jerk,
            s.sprint_speed
        FROM valid v JOIN at_contact k ON k.game_str = v.game_str AND k.play_id = v.play_id
        LEFT JOIN speeds s ON s.runner_id = v.first_baserunner
        WHERE base_state <> '111' AND k.l0 IS NOT NULL"""),
    "alone": (("gi",), f"""
        SELECT DISTINCT game_str, play_per_game AS play_id FROM gi WHERE {FIRST_ONLY}"""),
    "kinds": (("alone", "ge"), """
        SELECT game_str, play_id,
            CASE WHEN bool_or(code = 6) THEN 'pickoff' ELSE 'pitch' END AS play_type
        FROM ge WHERE code IN (1, 6) AND (game_str, play_id) IN (SELECT (game_str, play_id) FROM alone)
        GROUP BY ALL"""),
    "aims": (("kinds", "release"), """
        SELECT game_str, play_id, play_type,
            rel - CASE play_type WHEN 'pitch' THEN 1250 ELSE 725 END AS aim
        FROM kinds JOIN release USING (game_str, play_id)"""),
    # the nearest frame is chosen before frames without look-back are dropped
    "chosen": (("aims", "samples"), _moment("samples", "aim", "early", "aims").replace(
        "k.*", "k.*, play_type")),
    "profile": (("chosen",), f"""
        SELECT game_str, play_id, play_type, l0 AS lead_distance, v0 AS velocity,
            a0 AS acceleration, j0 AS jerk FROM ({_kin_mid('chosen')})"""),
}


def sql(tail, *names):
    return script(tail, *names, more=MORE)


def rounded(*columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def round_columns(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def fx(spark, sf):
    return fixture.derived(spark, sf)


KIN = ["lead_distance", "velocity", "acceleration", "jerk"]

# -- sources -----------------------------------------------------------------------


def _digest(t):
    parts = [
        t.game_info.groupBy("game_str").agg(
            F.lit("game_info").alias("source"), F.count("*").alias("n"),
            F.count_distinct("play_per_game").alias("plays"),
            F.coalesce(F.sum("at_bat"), F.lit(0)).cast("double").alias("total")),
        t.game_events.groupBy("game_str").agg(
            F.lit("game_events").alias("source"), F.count("*").alias("n"),
            F.count_distinct("play_id").alias("plays"),
            F.sum(F.col("timestamp") * F.col("event_code")).cast("double").alias("total")),
        t.player_pos.groupBy("game_str").agg(
            F.lit("player_pos").alias("source"), F.count("*").alias("n"),
            F.count_distinct("play_id").alias("plays"),
            F.round(F.sum(F.col("field_x") + F.col("field_y") * 2), 4).alias("total")),
        t.ball_pos.groupBy("game_str").agg(
            F.lit("ball_pos").alias("source"), F.count("*").alias("n"),
            F.count_distinct("play_id").alias("plays"),
            F.round(F.sum(F.col("ball_position_y") + F.col("ball_position_z")), 4).alias("total")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@check(sql("""
SELECT game_str, 'game_info' AS source, count(*) AS n, count(DISTINCT play_per_game) AS plays,
    coalesce(sum(at_bat), 0)::DOUBLE AS total FROM gi GROUP BY game_str
UNION ALL SELECT game_str, 'game_events', count(*), count(DISTINCT play_id),
    sum(ts * code)::DOUBLE FROM ge GROUP BY game_str
UNION ALL SELECT game_str, 'player_pos', count(*), count(DISTINCT play_id),
    round(sum(x + y * 2), 4) FROM pp GROUP BY game_str
UNION ALL SELECT game_str, 'ball_pos', count(*), count(DISTINCT play_id),
    round(sum(b_y + bz), 4) FROM bp GROUP BY game_str""", "gi", "ge", "pp", "bp"), name="load_tracking")
def load_tracking_query(spark, sf):
    return _digest(load_tracking(spark, fixture.folder(spark, sf)))


NULLABLE = ["catcher", "batter", "first_baserunner", "second_baserunner", "third_baserunner"]


@check(sql("SELECT game_str, play_per_game, coalesce(at_bat, -1) AS at_bat, top_bottom_inning, "
           + ", ".join(f"coalesce({c}, '-') AS {c}" for c in NULLABLE) + " FROM gi", "gi"))
def canonicalise_game_info(spark, sf):
    return fx(spark, sf).game_info.select(
        "game_str", "play_per_game", F.coalesce("at_bat", F.lit(-1)).alias("at_bat"),
        "top_bottom_inning", *[F.coalesce(c, F.lit("-")).alias(c) for c in NULLABLE])


@check(sql("""
SELECT game_str, play_id, pos AS player_position, count(*) AS n, min(ts) AS lo, max(ts) AS hi,
    round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y
FROM pp WHERE (game_str, play_id) IN (SELECT (game_str, play_id) FROM tries)
GROUP BY ALL""", "pp", "tries"))
def frames_for_plays(spark, sf):
    t = fx(spark, sf)
    frames = leads.frames_for(pickoffs.pickoff_attempts(t), t.player_pos)
    return frames.groupBy(*PLAY, "player_position").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        F.round(F.sum("field_x"), 4).alias("sum_x"), F.round(F.sum("field_y"), 4).alias("sum_y"))


@check(sql("SELECT game_str, play_id, ts AS t, pos, code FROM ge", "ge"))
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "sink")
    write_partitioned(fx(spark, sf).game_events, path)
    return spark.read.parquet(path).select(
        "game_str", "play_id", F.col("timestamp").alias("t"),
        F.col("player_position").alias("pos"), F.col("event_code").alias("code"))


# -- filters, projections, scalars ---------------------------------------------------

@check(sql("""SELECT p.game_str, p.play_id, p.pos, count(*) AS n, sum(p.ts)::BIGINT AS t,
    round(sum(p.x), 4) AS x, round(sum(p.y), 4) AS y FROM pp p
WHERE p.game_str IN ('G0', 'G7', 'G10') GROUP BY ALL""", "pp"), name="load_games")
def load_games_query(spark, sf):
    """Some games out of the partitioned sink; only their files are read."""
    path = scratch_path(spark, "games")
    write_tracking(fx(spark, sf), path)
    rows = load_games(spark, path, ["G0", "G7", "G10"]).player_pos
    return rows.groupBy("game_str", "play_id", F.col("player_position").alias("pos")).agg(
        F.count("*").alias("n"), F.sum("timestamp").alias("t"),
        F.round(F.sum("field_x"), 4).alias("x"), F.round(F.sum("field_y"), 4).alias("y"))


@check(sql("""SELECT game_str, play_id, pos, ts AS t, CASE WHEN ts % 200 = 0 THEN NULL ELSE round(x, 6) END
    AS x FROM pp WHERE pos = 11""", "pp"))
def text_coordinates(spark, sf):
    """Coordinates that come as text, some of them marked as missing."""
    raw = fixture.raw_tables(spark, sf)["player_pos"].where("player_position = 11")
    text = raw.withColumn("field_x", F.when(
        F.col("timestamp") % 200 == 0, "NA").otherwise(F.col("field_x").cast("string")))
    rows = canonicalise(text, CANONICAL["player_pos"])
    return rows.select("game_str", "play_id", F.col("player_position").alias("pos"),
                       F.col("timestamp").alias("t"), F.round("field_x", 6).alias("x"))


@check(sql("SELECT * FROM who", "who"))
def map_runner_ids(spark, sf):
    rows = people.runner_ids(fx(spark, sf))
    return rows.withColumnRenamed("player_position", "pos")


@check(sql("""SELECT game_str, play_per_game, first_baserunner IS NOT NULL AS is_on,
    second_baserunner IS NULL AS is_empty FROM gi""", "gi"))
def occupied_first(spark, sf):
    return fx(spark, sf).game_info.select(
        "game_str", "play_per_game", states.occupied("first_baserunner").alias("is_on"),
        states.empty("second_baserunner").alias("is_empty"))


@check(sql(f"SELECT game_str, play_per_game, first_baserunner FROM gi WHERE {FIRST_ONLY}", "gi"))
def runner_on_first_only(spark, sf):
    return fx(spark, sf).game_info.where(states.runner_on_first_only()).select(
        "game_str", "play_per_game", "first_baserunner")


@check(sql("""SELECT game_str, play_per_game, at_bat FROM gi_raw
WHERE TRY_CAST(at_bat AS INTEGER) IS NOT NULL""", "gi_raw"))
def castable_at_bat(spark, sf):
    raw = fixture.raw_tables(spark, sf)["game_info"]
    return raw.where(scalars.to_int(F.col("at_bat")).isNotNull()).select(
        "game_str", "play_per_game", "at_bat")


@check(sql("""SELECT game_str, play_per_game, coalesce(TRY_CAST(at_bat AS INTEGER), -1) AS at_bat,
    coalesce(TRY_CAST(substr(batter, 2) AS INTEGER), -1) AS number,
    coalesce(TRY_CAST(batter AS INTEGER), -1) AS never FROM gi_raw""", "gi_raw"))
def try_cast_int(spark, sf):
    raw = fixture.raw_tables(spark, sf)["game_info"]
    texts = {"at_bat": F.col("at_bat"), "number": F.substring("batter", 2, 9),
             "never": F.col("batter")}
    return raw.select("game_str", "play_per_game", *[
        F.coalesce(scalars.to_int(text), F.lit(-1)).alias(name) for name, text in texts.items()])


@check(sql(f"""SELECT game_str, play_id, count(*) AS n, min(ts) AS since FROM pp
WHERE pos = 11 AND {_dist('x', 'y', '0', '120')} <= 45 GROUP BY ALL""", "pp"))
def near_second(spark, sf):
    frames = moments.runner_on_first_frames(fx(spark, sf))
    return frames.where(scalars.within(
        F.col("field_x"), F.col("field_y"), codes.SECOND_BASE, 45)).groupBy(*PLAY).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("since"))


@check(sql("""SELECT game_str, play_per_game FROM gi WHERE first_baserunner IS NOT NULL
    AND (catcher IS NOT NULL OR at_bat IS NOT NULL)""", "gi"))
def has_features(spark, sf):
    return fx(spark, sf).game_info.where(
        scalars.has_features(["first_baserunner"], ["catcher", "at_bat"])).select(
        "game_str", "play_per_game")


@check(sql("""SELECT game_str, play_per_game, at_bat, catcher FROM gi
WHERE at_bat IS NOT NULL AND catcher IS NOT NULL""", "gi"))
def complete_cases(spark, sf):
    return fx(spark, sf).game_info.na.drop(subset=["at_bat", "catcher"]).select(
        "game_str", "play_per_game", "at_bat", "catcher")


@check(sql("SELECT play_id, game_str, base_state FROM told", "told"))
def base_state_code(spark, sf):
    return balls_in_play.bip_results(balls_in_play.bip_plays(fx(spark, sf))).select(
        *PLAY, "base_state")


@check(sql("""SELECT game_str, play_id, count(v0) AS n, round(sum(v0), 4) AS total,
    round(sum(z0), 4) AS zero_total FROM (
    SELECT k.*, z.v0 AS z0 FROM kin k JOIN kin_zero z USING (game_str, play_id, t0))
GROUP BY ALL""", "kin", "kin_zero"))
def diff_quotient(spark, sf):
    rows = moments.runner_lookback(fx(spark, sf))
    now, back = "near", "back_100"
    lead = {p: moments.lead_distance(F.col(f"{p}.field_x"), F.col(f"{p}.field_y"))
            for p in (now, back)}
    times = F.col(f"{now}.timestamp"), F.col(f"{back}.timestamp")
    null, zero = F.lit(None).cast("double"), F.lit(0.0)
    return rows.select(*PLAY, *[
        scalars.diff_quotient(lead[now], lead[back], *times, undefined).alias(name)
        for name, undefined in (("v", null), ("z", zero))
    ]).groupBy(*PLAY).agg(F.count("v").alias("n"), F.round(F.sum("v"), 4).alias("total"),
                          F.round(F.sum("z"), 4).alias("zero_total"))


# -- joins and choices ---------------------------------------------------------------

@check(sql(f"""SELECT game_str, play_id, ts AS t, code FROM ge
WHERE (game_str, play_id) IN (SELECT (game_str, play_id) FROM pp
    WHERE pos = 11 AND {_dist('x', 'y', '0', '120')} < 45)""", "ge", "pp"))
def semi_join_near_second(spark, sf):
    t = fx(spark, sf)
    return relational.keep_keys(t.game_events, steals.plays_near_second(t), PLAY).select(
        *PLAY, F.col("timestamp").alias("t"), F.col("event_code").alias("code"))


@check(sql(f"""SELECT b.game_str, b.play_id, count(*) AS n,
    round(sum({_dist('b.bx', 'b.b_y', 'p.x', 'p.y')}), 4) AS total
FROM bp b JOIN pp p ON b.game_str = p.game_str AND b.play_id = p.play_id AND b.ts = p.ts
WHERE p.pos = 1 GROUP BY ALL""", "bp", "pp"))
def sync_frames(spark, sf):
    t = fx(spark, sf)
    pitcher = t.player_pos.where(F.col("player_position") == codes.PITCHER).drop("player_position")
    apart = scalars.distance(F.col("ball_position_x"), F.col("ball_position_y"),
                             (F.col("field_x"), F.col("field_y")))
    return temporal.sync_frames(t.ball_pos, pitcher, FRAME).groupBy(*PLAY).agg(
        F.count("*").alias("n"), F.round(F.sum(apart), 4).alias("total"))


@check(sql("""SELECT p.game_str, p.play_id, p.pos, count(*) AS n, count(b.bz) AS with_ball,
    round(sum(p.x + coalesce(b.b_y, 0)), 4) AS total
FROM pp p LEFT JOIN (SELECT * FROM bp WHERE ts >= 500) b
    ON b.game_str = p.game_str AND b.play_id = p.play_id AND b.ts = p.ts
WHERE p.pos < 14 GROUP BY ALL""", "bp", "pp"))
def sync_frames_left(spark, sf):
    t = fx(spark, sf)
    late = t.ball_pos.where("`timestamp` >= 500")
    players = t.player_pos.where(F.col("player_position") < codes.POSITIONS_END)
    return temporal.sync_frames(players, late, FRAME, "left").groupBy(
        *PLAY, F.col("player_position").alias("pos")).agg(
        F.count("*").alias("n"), F.count("ball_position_z").alias("with_ball"),
        F.round(F.sum(F.col("field_x") + F.coalesce("ball_position_y", F.lit(0.0))), 4)
        .alias("total"))


@check(sql("""SELECT a.game_str, a.play_per_game, coalesce(n.play_per_game, -1) AS next_play,
    coalesce(n.batter, '-') AS next_batter
FROM gi a LEFT JOIN gi n ON n.game_str = a.game_str AND n.play_per_game = a.play_per_game + 1""",
           "gi"))
def next_state_plus_one(spark, sf):
    info = fx(spark, sf).game_info.select("game_str", "play_per_game", "batter")
    rows = temporal.next_state(info.drop("batter"), info, ["game_str"], "play_per_game")
    return rows.select("game_str", "play_per_game",
                       F.coalesce("next_play_per_game", F.lit(-1)).alias("next_play"),
                       F.coalesce("next_batter", F.lit("-")).alias("next_batter"))


@check(sql("""SELECT a.game_str, a.play_per_game, n.play_per_game AS next_play,
    n.second_baserunner AS next_second
FROM gi a JOIN gi n ON n.game_str = a.game_str AND n.play_per_game = (
    SELECT min(m.play_per_game) FROM gi m WHERE m.game_str = a.game_str
        AND m.second_baserunner IS NOT NULL AND m.play_per_game > a.play_per_game)
WHERE a.second_baserunner IS NOT NULL""", "gi"))
def next_state_lead(spark, sf):
    states_ = fx(spark, sf).game_info.where(states.occupied("second_baserunner")).select(
        "game_str", "play_per_game", "second_baserunner")
    rows = temporal.next_state(states_, states_, ["game_str"], "play_per_game", gaps=True, width=10)
    return rows.select("game_str", "play_per_game", F.col("next_play_per_game").alias("next_play"),
                       F.col("next_second_baserunner").alias("next_second"))


def _lookback_digest():
    return ", ".join(
        f"count(t{i}) AS n{i}, sum(coalesce(t{i}, 0))::BIGINT AS t{i}, "
        f"round(sum(x{i}), 4) AS x{i}, round(sum(y{i} * t0), 2) AS y{i}" for i in (1, 2, 3))


@check(sql(f"SELECT game_str, play_id, {_lookback_digest()} FROM back GROUP BY ALL", "back"))
def lookback_xy(spark, sf):
    rows = moments.runner_lookback(fx(spark, sf))
    sums = []
    for i, lag in enumerate(moments.LAGS, 1):
        p = f"back_{lag}"
        sums += [
            F.count(f"{p}.timestamp").alias(f"n{i}"),
            F.sum(F.coalesce(f"{p}.timestamp", F.lit(0))).alias(f"t{i}"),
            F.round(F.sum(f"{p}.field_x"), 4).alias(f"x{i}"),
            F.round(F.sum(F.col(f"{p}.field_y") * F.col("timestamp")), 2).alias(f"y{i}")]
    return rows.groupBy(*PLAY).agg(*sums)


@check(sql(f"""SELECT game_str, play_id, t0 AS t, {rounded('x', 'y')} FROM (
    SELECT r.game_str, r.play_id, r.ts AS t0, r.x, r.y FROM runner r
    JOIN (SELECT game_str, play_id, min(ts) + 25 AS aim FROM ge WHERE code IN (1, 6) GROUP BY ALL) e
        ON e.game_str = r.game_str AND e.play_id = r.play_id
    QUALIFY row_number() OVER (PARTITION BY r.game_str, r.play_id
        ORDER BY abs(r.ts - aim), r.ts DESC) = 1)""", "runner", "ge"))
def nearest_in_time(spark, sf):
    t = fx(spark, sf)
    aims = t.game_events.where(F.col("event_code").isin(codes.PITCH, codes.PICKOFF)).groupBy(
        *PLAY).agg((F.min("timestamp") + 25).alias("aim"))
    rows = temporal.nearest(moments.runner_on_first_frames(t), aims, PLAY, "timestamp", "aim", XY,
                            CHUNK_MS, ties="late")
    return rows.select(*PLAY, F.col("near.timestamp").alias("t"),
                       F.round("near.field_x", 6).alias("x"), F.round("near.field_y", 6).alias("y"))


@check(sql("SELECT DISTINCT game_str, play_id, play_per_game FROM ge WHERE code = 2", "ge"))
def distinct_plays(spark, sf):
    return fx(spark, sf).game_events.where(F.col("event_code") == codes.ACQUIRED).select(
        *PLAY, "play_per_game").distinct()


@check(sql("""SELECT game_str, top_bottom_inning, at_bat, play_per_game, batter FROM gi
WHERE at_bat IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY game_str, top_bottom_inning, at_bat
    ORDER BY play_per_game DESC NULLS LAST, batter NULLS LAST, first_baserunner NULLS LAST) = 1""",
           "gi"))
def top1_tiebreak(spark, sf):
    return balls_in_play.last_row_of_at_bat(fx(spark, sf).game_info).select(
        "game_str", "top_bottom_inning", "at_bat", "play_per_game", "batter")


# -- motion and moments --------------------------------------------------------------

@check(sql(f"""SELECT game_str, play_id, round(sum({_dist('x', 'y', 'px', 'py')}), 6) AS path
FROM (SELECT *, lag(x, 1, x) OVER w AS px, lag(y, 1, y) OVER w AS py FROM runner
    WINDOW w AS (PARTITION BY game_str, play_id ORDER BY ts)) GROUP BY ALL""", "runner"))
def path_length(spark, sf):
    # chunks shorter than a play, so that the steps between chunks count
    frames = moments.runner_on_first_frames(fx(spark, sf))
    return round_columns(motion.path_length(frames, PLAY, "timestamp", *XY, 1000), "path")


@check(sql(f"""SELECT game_str, play_id, count(speed) AS n, round(max(speed), 6) AS top,
    round(sum(speed), 4) AS total, sum(covered)::BIGINT AS covered
FROM (SELECT *, ts - ft AS covered, {_dist('x', 'y', 'fx', 'fy')} / nullif(ts - ft, 0) * 1000 AS speed
    FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy,
            first_value(ts) OVER w AS ft FROM runner
        WINDOW w AS (PARTITION BY game_str, play_id ORDER BY ts
            RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)))
GROUP BY ALL""", "runner"))
def trailing_speed(spark, sf):
    frames = moments.runner_on_first_frames(fx(spark, sf))
    rows = motion.trailing_speed(frames, PLAY, "timestamp", *XY, 1000, 1500)
    return rows.groupBy(*PLAY).agg(
        F.count("speed").alias("n"), F.round(F.max("speed"), 6).alias("top"),
        F.round(F.sum("speed"), 4).alias("total"), F.sum("covered").alias("covered"))


@check(sql("SELECT game_str, play_id, rel AS release_timestamp FROM release", "release"))
def release_time(spark, sf):
    return moments.release_time(fx(spark, sf))


@check(sql(f"""SELECT game_str, play_id, count(*) AS n, round(max(d), 6) AS top,
    round(sum(d), 4) AS total FROM (SELECT *, {_dist('x', 'y', B1, B1)} AS d FROM runner)
GROUP BY ALL""", "runner"))
def lead_distance(spark, sf):
    frames = moments.runner_on_first_frames(fx(spark, sf))
    lead = moments.lead_distance(F.col("field_x"), F.col("field_y"))
    return frames.groupBy(*PLAY).agg(
        F.count("*").alias("n"), F.round(F.max(lead), 6).alias("top"),
        F.round(F.sum(lead), 4).alias("total"))


def _kin_digest_sql(table):
    parts = ", ".join(
        f"count({c}) AS n_{n}, round(sum({c}), 3) AS {n}, round(max({c}), 5) AS top_{n}"
        for c, n in zip(("l0", "v0", "a0", "j0"), KIN))
    return f"SELECT game_str, play_id, {parts} FROM {table} GROUP BY ALL"


def _kin_digest(rows):
    return rows.groupBy(*PLAY).agg(*[
        f(c).alias(p + c) for c in KIN for f, p in (
            (F.count, "n_"), (lambda c: F.round(F.sum(c), 3), ""),
            (lambda c: F.round(F.max(c), 5), "top_"))])


@check(sql(_kin_digest_sql("kin"), "kin"))
def kinematics_endpoint(spark, sf):
    return _kin_digest(moments.kinematics(moments.runner_lookback(fx(spark, sf))))


@check(sql(_kin_digest_sql("kin_mid"), "kin_mid"))
def kinematics_midpoint(spark, sf):
    return _kin_digest(moments.kinematics(moments.runner_lookback(fx(spark, sf)), "midpoint"))


def _kin_sql(alias="k"):
    return ", ".join(f"round({alias}.{c}, 6) AS {n}"
                     for c, n in zip(("l0", "v0", "a0", "j0"), KIN))


@check(sql(f"SELECT game_str, play_id, t0 AS t, {_kin_sql()} FROM at_pitch k", "at_pitch"))
def target_moment(spark, sf):
    t = fx(spark, sf)
    targets = moments.release_time(t).withColumn(
        "at", F.col("release_timestamp") - moments.BEFORE_PITCH)
    rows = moments.moment_before(t, targets, ties="late")
    return round_columns(
        rows.select(*PLAY, F.col("near.timestamp").alias("t"), *KIN), *KIN)


# -- people --------------------------------------------------------------------------

@check(sql(f"""SELECT runner_id, {rounded('sprint_speed')}, n AS num_plays_measured
FROM speeds""", "speeds"))
def sprint_speed(spark, sf):
    return round_columns(people.sprint_speed(fx(spark, sf)), "sprint_speed")


@check(sql(f"""SELECT runner_id, {rounded('sprint_speed')}, n AS num_plays_measured
FROM speeds ORDER BY sprint_speed DESC, runner_id""", "speeds"))
def leaderboard(spark, sf):
    rows = people.leaderboard(people.sprint_speed(fx(spark, sf)))
    return round_columns(rows, "sprint_speed")


@check(sql(f"SELECT catcher_id, {rounded('average_pop_time')}, total_throws FROM pops", "pops"))
def pop_time(spark, sf):
    return round_columns(people.pop_time(fx(spark, sf)), "average_pop_time")


@check(sql("SELECT count(DISTINCT game_str) AS total_games FROM gi", "gi"))
def game_count(spark, sf):
    return people.game_count(fx(spark, sf))


# -- pickoffs and steals ---------------------------------------------------------------

@check(sql("SELECT * FROM judged", "judged"))
def pickoff_label(spark, sf):
    t = fx(spark, sf)
    return pickoffs.pickoff_label(t, pickoffs.pickoff_attempts(t))


@check(sql("""SELECT count(*) AS attempts, count(*) FILTER (pickoff_result = 1) AS successes,
    round(avg((pickoff_result = 1)::INTEGER::DOUBLE), 6) AS success_rate
FROM judged WHERE pickoff_result <> -1""", "judged"))
def success_rate(spark, sf):
    t = fx(spark, sf)
    rows = pickoffs.pickoff_label(t, pickoffs.pickoff_attempts(t)).where("pickoff_result <> -1")
    done = F.col("pickoff_result") == 1
    return rows.agg(F.count("*").alias("attempts"), F.count_if(done).alias("successes"),
                    F.round(scalars.rate(done), 6).alias("success_rate"))


@check(sql(f"""SELECT j.*, {_kin_sql()}, round(s.sprint_speed, 6) AS sprint_speed
FROM judged j JOIN at_pickoff k ON k.game_str = j.game_str AND k.play_id = j.play_id
LEFT JOIN speeds s ON s.runner_id = j.runner_id WHERE j.pickoff_result <> -1""",
           "judged", "at_pickoff", "speeds"))
def pickoff_set(spark, sf):
    return round_columns(pickoffs.pickoff_set(fx(spark, sf)), *KIN, "sprint_speed")


@check(sql("SELECT * FROM ended", "ended"))
def steal_outcome(spark, sf):
    return steals.steal_outcome(fx(spark, sf))


@check(sql(f"""SELECT e.game_str, e.play_id, e.runner_id, e.catcher_id, e.outcome, {_kin_sql()},
    round(s.sprint_speed, 6) AS sprint_speed, round(p.average_pop_time, 6) AS average_pop_time
FROM ended e JOIN at_pitch k ON k.game_str = e.game_str AND k.play_id = e.play_id
LEFT JOIN speeds s ON s.runner_id = e.runner_id LEFT JOIN pops p ON p.catcher_id = e.catcher_id
WHERE k.l0 IS NOT NULL AND (s.sprint_speed IS NOT NULL OR p.average_pop_time IS NOT NULL)""",
           "ended", "at_pitch", "speeds", "pops"))
def steal_set(spark, sf):
    return round_columns(steals.steal_set(fx(spark, sf)), *KIN, "sprint_speed", "average_pop_time")


# -- balls in play ----------------------------------------------------------------------

NEXT = ["next_first", "next_second", "next_third"]


@check(sql("SELECT * REPLACE (" + ", ".join(f"coalesce({c}, '-') AS {c}" for c in NEXT)
           + ") FROM bip", "bip"))
def bip_plays(spark, sf):
    return balls_in_play.bip_plays(fx(spark, sf)).withColumns(
        {c: F.coalesce(c, F.lit("-")) for c in NEXT})


@check(sql("SELECT * FROM told", "told"))
def bip_results(spark, sf):
    return balls_in_play.bip_results(balls_in_play.bip_plays(fx(spark, sf)))


ENDS = ["batter_end_x", "batter_end_y", "runner_end_x", "runner_end_y"]


@check(sql("SELECT * REPLACE (" + rounded(*ENDS) + ") FROM valid", "valid"))
def bip_validated(spark, sf):
    return round_columns(balls_in_play.bip_validated(fx(spark, sf)), *ENDS)


@check(sql("SELECT * REPLACE (" + rounded(*ENDS, *KIN, "sprint_speed") + ") FROM hits", "hits"))
def bip_set(spark, sf):
    return round_columns(balls_in_play.bip_set(fx(spark, sf)), *ENDS, *KIN, "sprint_speed")


@check(sql("""SELECT batter_result, base_state, count(*) AS n FROM valid
WHERE batter_result IN ('1B', '2B')
    OR (batter_result = 'Out' AND base_state NOT IN ('110', '101', '011'))
GROUP BY ALL""", "valid"))
def split_counts(spark, sf):
    rows = materialise(balls_in_play.bip_validated(fx(spark, sf)))
    parts = [balls_in_play.training_rows(rows, r) for r in balls_in_play.RESULT_SETS]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("batter_result", "base_state").agg(F.count("*").alias("n"))


@check(sql("""SELECT v.game_str, v.play_id, v.batter, d.base_state FROM valid v
JOIN labels_2b d ON d.game_str = v.game_str AND d.play_id = v.play_id
WHERE v.batter_result = '2B' AND d.base_state IS NOT NULL""", "valid", "labels_2b"))
def overlay_labels(spark, sf):
    doubles = balls_in_play.training_rows(balls_in_play.bip_validated(fx(spark, sf)), "2B")
    return relational.overlay_labels(
        doubles, fixture.double_labels(spark, sf), PLAY, "base_state").select(
        *PLAY, "batter", "base_state")


# -- leads ------------------------------------------------------------------------------

@check(sql("SELECT * FROM kinds", "kinds"))
def play_type(spark, sf):
    t = fx(spark, sf)
    return leads.play_type(t, leads.single_runner_plays(t))


@check(sql(f"SELECT game_str, play_id, play_type, {rounded(*KIN)} FROM profile", "profile"))
def lead_profile(spark, sf):
    return round_columns(leads.lead_profile(fx(spark, sf)), *KIN)


@check(sql("SELECT i AS share, " + ", ".join(
    f"round((SELECT quantile_cont({c}, [{', '.join(map(str, leads.SHARES))}]) FROM profile)[n], 6) "
    f"AS {c}" for c in KIN) + f""" FROM (SELECT unnest({leads.SHARES}::DOUBLE[]) AS i,
    unnest(range(1, {len(leads.SHARES) + 1})) AS n)""", "profile"))
def lead_scenarios(spark, sf):
    rows = leads.lead_scenarios(materialise(leads.lead_profile(fx(spark, sf))))
    return round_columns(rows, *KIN)


@check(sql("""SELECT p.game_str, p.play_id, p.pos, CASE WHEN p.pos BETWEEN 10 AND 13 THEN 'runner'
    ELSE 'fielder' END AS role, count(*) AS n,
    round(sum(CASE WHEN b.bz IS NULL THEN 0 ELSE greatest(10, b.bz * 8) END), 4) AS size
FROM pp p LEFT JOIN bp b ON b.game_str = p.game_str AND b.play_id = p.play_id AND b.ts = p.ts
WHERE p.pos < 14 GROUP BY ALL""", "pp", "bp"))
def annotate_frames(spark, sf):
    return leads.annotate_frames(fx(spark, sf)).groupBy(
        *PLAY, F.col("player_position").alias("pos"), "role").agg(
        F.count("*").alias("n"), F.round(F.sum("ball_size"), 4).alias("size"))


@check(sql(""", series AS (
    SELECT game_str, play_id, pos, ts, x, y, NULL::DOUBLE AS z FROM pp WHERE pos < 14
    UNION ALL SELECT game_str, play_id, 0, ts, bx, b_y, bz FROM bp
        WHERE (game_str, play_id, ts) IN (SELECT (game_str, play_id, ts) FROM pp WHERE pos < 14)),
clock AS (SELECT game_str, play_id, min(ts) AS lo, max(ts) AS hi FROM series GROUP BY ALL),
grid AS (
    SELECT s.game_str, s.play_id, s.pos, i AS step, lo + (hi - lo) * i / 99::DOUBLE AS instant
    FROM (SELECT DISTINCT game_str, play_id, pos FROM series) s
    JOIN clock c ON c.game_str = s.game_str AND c.play_id = s.play_id,
    (SELECT unnest(range(100)) AS i))
SELECT g.game_str, g.play_id, CAST(g.pos AS INTEGER) AS pos, count(*) AS n, round(sum(instant), 3) AS instants,
    round(sum(s.x * step), 3) AS x, round(sum(s.y * step), 3) AS y, round(sum(s.z), 4) AS z
FROM grid g ASOF JOIN series s ON s.game_str = g.game_str AND s.play_id = g.play_id
    AND s.pos = g.pos AND g.instant >= s.ts
GROUP BY ALL""", "pp", "bp"))
def resample_play(spark, sf):
    rows = leads.resample_play(fx(spark, sf))
    return rows.groupBy(*PLAY, F.col("player_position").alias("pos")).agg(
        F.count("*").alias("n"), F.round(F.sum("instant"), 3).alias("instants"),
        F.round(F.sum(F.col("field_x") * F.col("step")), 3).alias("x"),
        F.round(F.sum(F.col("field_y") * F.col("step")), 3).alias("y"),
        F.round(F.sum("z"), 4).alias("z"))
