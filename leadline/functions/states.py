"""Column functions over base occupancy and play results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadline.functions.codes import OCCUPANTS
from leadline.functions.scalars import any_of


def occupied(base: str) -> Column:
    return F.col(base).isNotNull()


def empty(base: str) -> Column:
    return F.col(base).isNull()


def runner_on_first_only() -> Column:
    return occupied("first_baserunner") & empty("second_baserunner") & empty("third_baserunner")


def occupant_of(position: Column) -> Column:
    """Person id of a runner position: 11, 12, 13 to who is on 1st, 2nd, 3rd."""
    chosen = F.lit(None).cast("string")
    for code, column in OCCUPANTS.items():
        chosen = F.when(position == code, F.col(column)).otherwise(chosen)
    return chosen


def base_reached(person: Column, first: Column, second: Column, third: Column,
                 nowhere: str) -> Column:
    """Which base a person holds in the next state."""
    return (
        F.when(person == first, "1B")
        .when(person == second, "2B")
        .when(person == third, "3B")
        .otherwise(nowhere)
    )


def base_state(*results: Column) -> Column:
    """Three digits, one per base, 1 where any of the results names that base."""
    return F.concat(*[
        F.when(any_of(r == base for r in results), "1").otherwise("0")
        for base in ("1B", "2B", "3B")
    ])


def role(position: Column) -> Column:
    return F.when(position.between(10, 13), "runner").otherwise("fielder")


def ball_size(z: Column) -> Column:
    """Marker size of the ball: eight per foot of height, never under ten, 0 unseen."""
    return F.when(z.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(10.0), z * F.lit(8.0)))
