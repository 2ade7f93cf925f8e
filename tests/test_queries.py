"""Every registered query: values against DuckDB, and the shape of its plan."""

import math
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}
ORACLES = oracle_sql()
# Their oracles hold for any right fit, so small ones do here; test_full_fits has the settings.
FITS = {"fit_boost", "fit_boost_multi", "fit_forest", "importance_totals",
        *(n for n in ORACLES if n.startswith("scored_"))}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture
def small_fits(monkeypatch):
    from leadline.plans import models
    forest, boost = models.forest_models, models.boost
    monkeypatch.setattr(models, "forest_models", lambda rows, trees, depth, seed: forest(rows, 5, 4, seed))
    monkeypatch.setattr(models, "boost", lambda rows, features, classes, rounds, depth=5, step=0.1, **s:
                        boost(rows, features, classes, min(rounds, 3), 2, step, **s))


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, request, name):
    if name in FITS:
        request.getfixturevalue("small_fits")
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEval", "InPandas"):
        assert banned not in plan
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    rows = ordered(df.select(*columns).collect())
    assert rows, "no rows"
    assert rows == ordered(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name, rows", [("importance", 12), ("payoff_scenarios", 14), ("compare_models", 25)])
def test_rows_only(spark, small_fits, name, rows):
    found = queries()[name](spark, SF).collect()
    assert len(found) == rows
    if name == "compare_models":
        assert all(0 <= r.auc <= 1 and r.median_auc <= 1 for r in found)


def test_entry(spark):
    assert set(entry(spark).columns) == {"runner_id", "sprint_speed", "num_plays_measured"}
    assert set(ORACLES) <= set(queries())


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution()
                          .executedPlan().toString()))


def test_filters_and_columns_reach_the_files(spark):
    from leadline.checks import fixture
    from leadline.plans.moments import runner_on_first_frames
    frames = runner_on_first_frames(fixture.tracking(spark, SF)).where("game_str = 'G3'").select(
        "timestamp")
    plan = frames._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "EqualTo(game_str,G3)" in pushed and "EqualTo(player_position,11)" in pushed
    assert "field_x" not in re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)


def test_three_lags_share_one_exchange_of_the_rows(spark):
    """One for the rows; the other two move the chunk summary only."""
    from leadline.checks import fixture
    from leadline.plans.moments import runner_lookback
    df = runner_lookback(fixture.tracking(spark, SF))
    one = exchanges(df)
    assert one <= 4 and df._jdf.queryExecution().executedPlan().toString().count("Window") <= 4


def test_games_are_read_out_of_their_folders(spark, tmp_path):
    from leadline.checks import fixture
    from leadline.sources.tracking import load_game, load_games, write_tracking
    whole = fixture.tracking(spark, SF)
    write_tracking(whole, str(tmp_path / "games"))
    some = load_games(spark, str(tmp_path / "games"), ["G3", "G5"])
    for name in ("game_info", "game_events", "player_pos", "ball_pos"):
        df, want = getattr(some, name), getattr(whole, name).where("game_str IN ('G3', 'G5')")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*game_str[^\]]* IN \(G3,G5\)", plan)
        assert df.columns == want.columns and df.count() == want.count() > 0
        assert df.exceptAll(want).isEmpty()
    assert load_game(spark, str(tmp_path / "games"), "G3").ball_pos.count() == some.ball_pos.where(
        "game_str = 'G3'").count()


def test_only_the_folders_of_the_games_are_listed(spark, tmp_path):
    from leadline.checks import fixture
    from leadline.sources.tracking import load_games, write_partitioned
    events = fixture.tracking(spark, SF).game_events.where("game_str IN ('G1', 'G3', 'G5')")
    for name in ("game_info", "game_events", "player_pos", "ball_pos"):
        write_partitioned(events, str(tmp_path / name))
    found = {games: load_games(spark, str(tmp_path), games).game_events
             for games in (("G3", "none"), ("none",), (), ("G3", "G*"))}
    assert {re.search("game_str=([^/]*)", f).group(1) for f in found["G3", "none"].inputFiles()} == {"G3"}
    three = events.where("game_str = 'G3'").count()
    assert {k: df.count() for k, df in found.items()} == {
        ("G3", "none"): three, ("none",): 0, (): 0, ("G3", "G*"): three}
