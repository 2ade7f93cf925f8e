"""The four tracking tables: schemas, loading, canonical form, partitioned sink."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.functions.scalars import known, to_int
from leadline.sources.folders import local_place, write_folders

RAW = {
    "game_info": "game_str string, play_per_game int, at_bat string, "
                 "top_bottom_inning string, catcher string, batter string, "
                 "first_baserunner string, second_baserunner string, third_baserunner string",
    "game_events": "game_str string, play_id int, play_per_game int, `timestamp` long, "
                   "player_position int, event_code int",
    "player_pos": "game_str string, play_id int, `timestamp` long, player_position int, "
                  "field_x double, field_y double",
    "ball_pos": "game_str string, play_id int, `timestamp` long, "
                "ball_position_x double, ball_position_y double, ball_position_z double",
}

CANONICAL = {
    "game_info": dict(
        game_str="key", play_per_game="int", at_bat="int", top_bottom_inning="string",
        catcher="string", batter="string", first_baserunner="string",
        second_baserunner="string", third_baserunner="string"),
    "game_events": dict(
        game_str="key", play_id="int", play_per_game="int", timestamp="bigint",
        player_position="int", event_code="int"),
    "player_pos": dict(
        game_str="key", play_id="int", timestamp="bigint", player_position="int",
        field_x="double", field_y="double"),
    "ball_pos": dict(
        game_str="key", play_id="int", timestamp="bigint", ball_position_x="double",
        ball_position_y="double", ball_position_z="double"),
}


@dataclass(frozen=True)
class Tracking:
    game_info: DataFrame
    game_events: DataFrame
    player_pos: DataFrame
    ball_pos: DataFrame


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_one_game(df: DataFrame) -> DataFrame:
    """Fail at run time when rows of more than one game come through.

    The check is one aggregate row compared with each row, not a collect.
    """
    games = df.agg(F.min("game_str").alias("lo"), F.max("game_str").alias("hi"))
    same = games.select(F.col("lo").eqNullSafe(F.col("hi"))).scalar()
    return df.where(F.assert_true(same, F.lit("more than one game")).isNull())


def canonicalise(df: DataFrame, spec: dict) -> DataFrame:
    """Typed columns of ``spec``; 'NA' and unreadable numbers become null.

    A column of kind ``key`` is passed through untouched, so that filters on it still
    reach the files.
    """
    require_columns(df, spec)
    types = dict(df.dtypes)

    def typed(name: str, kind: str):
        column = F.col(name)
        if kind == "key":
            return column
        if types[name] == "string":
            if kind == "string":
                return known(column)
            return to_int(column) if kind == "int" else column.try_cast(kind)
        return column.cast(kind)

    return df.select(*[typed(name, kind).alias(name) for name, kind in spec.items()])


def canonical_tracking(game_info, game_events, player_pos, ball_pos) -> Tracking:
    tables = dict(game_info=game_info, game_events=game_events,
                  player_pos=player_pos, ball_pos=ball_pos)
    return Tracking(**{n: canonicalise(df, CANONICAL[n]) for n, df in tables.items()})


def load_tracking(spark: SparkSession, folder: str) -> Tracking:
    """Read the four tables with their schemas stated, so no file is sampled."""
    return canonical_tracking(**{
        name: spark.read.schema(T.StructType.fromDDL(ddl)).parquet(f"{folder}/{name}")
        for name, ddl in RAW.items()
    })


def load_games(spark: SparkSession, folder: str, games) -> Tracking:
    """The tables of some games out of a folder that ``write_tracking`` wrote.

    Only the folders of these games are listed and their files read, whatever else is there.
    """
    games = list(games)
    wanted = F.col("game_str").isin(*games)
    tables = {}
    for name, spec in CANONICAL.items():
        kinds = {c: "string" if kind == "key" else kind for c, kind in spec.items()}
        schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
        rows = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(
            *_game_folders(spark, f"{folder}/{name}", games))
        tables[name] = rows.select(*spec).where(wanted)
    return Tracking(**tables)


def _game_folders(spark: SparkSession, path: str, games) -> list[str]:
    """The folders of the games that are there; the whole table if there is none, or if some
    name is not spelt in its folder as it is."""
    if not all(re.fullmatch(r"[A-Za-z0-9_.-]+", g or "") for g in games):
        return [path]
    places = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/game_str={g}") for g in games]
    files = spark._jsc.hadoopConfiguration()
    return [p.toString() for p in places if p.getFileSystem(files).exists(p)] or [path]


def load_game(spark: SparkSession, folder: str, game: str) -> Tracking:
    """One game, as the drawing of a play needs it; frames of any other game are an error."""
    t = load_games(spark, folder, [game])
    return replace(t, player_pos=require_one_game(t.player_pos),
                   ball_pos=require_one_game(t.ball_pos))


def write_tracking(t: Tracking, folder: str, mode: str = "errorifexists") -> None:
    """The four tables, one folder per game in each."""
    for f in fields(t):
        write_partitioned(getattr(t, f.name), f"{folder}/{f.name}", mode=mode)


def write_partitioned(df: DataFrame, path: str, by: str = "game_str",
                      mode: str = "errorifexists") -> None:
    """Write one folder per group.

    Rows are rebalanced by group: adaptive execution merges small groups into one task
    and splits a very large one over several, so there are neither many tiny files nor
    one endless writer. A new table on a local disk is written by the tasks themselves.
    """
    rows = df.hint("rebalance", F.col(by))
    local = local_place(df, path, by) if mode == "errorifexists" else None
    if local is None:
        rows.write.mode(mode).partitionBy(by).parquet(path)
    else:
        write_folders(rows, local, by)
