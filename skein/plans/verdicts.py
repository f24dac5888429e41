"""Verdicts: ordered decisions over measured values, as expressions that keep "unknown" apart.

Every verdict puts its preconditions first and says UNDECIDED where a value is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: fixed limits of the decisions
LEGAL_RATE, LEAK_RATE, MOVED_RANKS, SATURATED, CEILING = 0.90, 0.20, 2, 0.999, 0.90


def _known(value: Column, decided: Column) -> Column:
    return F.when(value.isNull(), F.lit("UNDECIDED")).otherwise(decided)


def internalised(legal_rate: Column, prompted: Column) -> Column:
    """FIRES if legality comes from the prompt or its rate is under the limit."""
    return F.when(prompted, "FIRES").otherwise(_known(legal_rate, F.when(legal_rate < LEGAL_RATE, "FIRES").otherwise("HOLDS")))


def both_directions(render: Column, speak: Column) -> Column:
    return _known(render + speak, F.when(F.least(render, speak) < LEGAL_RATE, "FIRES").otherwise("HOLDS"))


def is_noise(delta: Column, mde: Column) -> Column:
    """FIRES if a difference does not exceed the smallest detectable one."""
    return _known(delta + mde, F.when(delta <= mde, "FIRES").otherwise("HOLDS"))


def leaks(rate: Column) -> Column:
    return _known(rate, F.when(rate > LEAK_RATE, "FIRES").otherwise("HOLDS"))


def headroom(noise: Column, mde: Column) -> Column:
    return 1 - noise > mde


def acceptance(low: Column, high: Column, n: Column, bar: Column, least: int = 30) -> Column:
    """ACCEPTED above the bar, REJECTED below it, UNDECIDED while the interval holds it or n is small."""
    return F.when((n < least) | low.isNull(), "UNDECIDED").when(low > bar, "ACCEPTED").when(high < bar, "REJECTED").otherwise("UNDECIDED")


def direction(delta: Column) -> Column:
    return _known(delta, F.when(delta < 0, "CONVERGENCE").when(delta > 0, "DIVERGENCE").otherwise("NONE"))


def panel(admitted: Column) -> Column:
    """HALT without an admitted observable, NARROW with fewer than three."""
    return F.when(admitted == 0, "HALT").when(admitted < 3, "NARROW").otherwise("PANEL")


def admitted(rank_range: Column, upper: Column) -> Column:
    """A rank that moves at most two places and an upper limit under a half; a missing or NaN limit is never admitted."""
    return F.coalesce((rank_range <= MOVED_RANKS) & (upper < 0.5) & ~F.isnan(upper.cast("double")), F.lit(False))


def curve(first: Column, least: Column) -> Column:
    return F.when(least >= SATURATED, "SATURATED").when((first >= CEILING) & (least >= CEILING), "CEILING").otherwise("OPEN")


def carry_decision(rate: Column, low: Column, high: Column, n: Column, least: int = 150, target: float = 0.65, floor: float = 0.5) -> Column:
    """UNDECIDED under ``least`` pairs; ACCEPTED if the interval clears the floor and the rate the target; REJECTED if it lies under the floor."""
    return F.when((n < least) | low.isNull(), "UNDECIDED").when((low > floor) & (rate >= target), "ACCEPTED").when(high <= floor, "REJECTED").otherwise("UNDECIDED")


def over_axes(found: Column, readable: Column, axes: WindowSpec) -> Column:
    """RECOVERED if any axis of the window shows an effect, WITHHELD if one could not have, BOUNDARY else."""
    return F.when(F.bool_or(found).over(axes), "RECOVERED").when(F.bool_or(~readable).over(axes), "WITHHELD").otherwise("BOUNDARY")


def recovered(significant: Column, readable: Column) -> Column:
    """RECOVERED on a significant readable axis, WITHHELD if nothing could be read, BOUNDARY else."""
    return F.when(~readable, "WITHHELD").when(significant, "RECOVERED").otherwise("BOUNDARY")
