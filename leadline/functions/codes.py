"""Code books and field geometry.

Fixed values: event codes, position codes, base coordinates in feet.
"""

from __future__ import annotations

import math

PITCH, ACQUIRED, THROW = 1, 2, 3
IN_PLAY, END_OF_PLAY, PICKOFF, DEFLECTION = 4, 5, 6, 10

PITCHER, CATCHER = 1, 2
MIDDLE_INFIELD = (4, 6)
BATTER = 10
RUNNER_FIRST, RUNNER_SECOND, RUNNER_THIRD = 11, 12, 13
RUNNERS = (RUNNER_FIRST, RUNNER_SECOND, RUNNER_THIRD)
POSITIONS_END = 14  # 14 and up is nobody on the field

FIRST_BASE = (45 * math.sqrt(2), 45 * math.sqrt(2))
SECOND_BASE = (0.0, 120.0)
THIRD_BASE = (-45 * math.sqrt(2), 45 * math.sqrt(2))

OCCUPANTS = {
    RUNNER_FIRST: "first_baserunner",
    RUNNER_SECOND: "second_baserunner",
    RUNNER_THIRD: "third_baserunner",
}
BASES = {"1B": FIRST_BASE, "2B": SECOND_BASE, "3B": THIRD_BASE}

PLAY = ["game_str", "play_id"]
FRAME = ["game_str", "play_id", "timestamp"]
