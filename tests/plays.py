"""Small hand-made tracking tables."""

from __future__ import annotations

import math

from leadline.sources.tracking import RAW, canonical_tracking

FIRST = 45 * math.sqrt(2)


def info(play, at_bat=None, half="top", catcher="C1", batter="B1", first="R1", second="NA",
         third="NA", game="G"):
    return (game, play, str(play) if at_bat is None else at_bat, half, catcher, batter, first,
            second, third)


def event(play, ts, position, code, game="G"):
    return (game, play, play, ts, position, code)


def runner(play, lead_at, times=range(0, 4001, 50), position=11, game="G"):
    """Frames of a runner whose distance from first along the line is ``lead_at(ms)``."""
    return [(game, play, t, position, FIRST - lead_at(t) / math.sqrt(2),
             FIRST + lead_at(t) / math.sqrt(2)) for t in times]


def pitcher(play, times=range(0, 4001, 50), game="G"):
    return [(game, play, t, 1, 0.0, 60.0) for t in times]


def ball(play, released=2000, times=range(0, 4001, 50), low=0.0, game="G"):
    """In the pitcher's hand until ``released``, then on its way to the plate."""
    return [(game, play, t, 0.0, 60.0 if t < released else max(50.0 - (t - released) / 20, low),
             3.0) for t in times]


def make(spark, infos, events, players=(), balls=()):
    rows = dict(game_info=infos, game_events=events, player_pos=players, ball_pos=balls)
    return canonical_tracking(**{
        n: spark.createDataFrame(list(r), RAW[n]) for n, r in rows.items()})
