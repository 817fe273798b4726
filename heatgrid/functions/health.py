"""Heat-mortality arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative risk of death per +1 degree C by cause, with the ends of its 95 % interval.
CAUSES = [
    ("all_cause", 1.0200, 1.0140, 1.0260),
    ("mental_disorder", 1.0260, 1.0130, 1.0400),
    ("cardiovascular", 1.0344, 1.0310, 1.0378),
    ("respiratory", 1.0360, 1.0318, 1.0402),
    ("self_harm", 1.0120, 1.0030, 1.0210),
]


def beta_from_rr(rr: Column) -> Column:
    """Log-linear slope per degree."""
    return F.log(rr)


def se_from_ci(low: Column, high: Column, z: float = 1.96) -> Column:
    """Standard error of the slope from the ends of the interval of the relative risk."""
    return (F.log(high) - F.log(low)) / (2 * z)


def rr_from_delta(beta: Column, delta: Column) -> Column:
    return F.exp(beta * delta)


def attributable_fraction(beta: Column, delta: Column) -> Column:
    """(RR - 1) / RR as -expm1(-beta dT); null where it is not finite."""
    af = -F.expm1(-beta * delta)
    return F.when(~F.isnan(af) & (F.abs(af) != float("inf")), af)


def adjusted_deaths(deaths: Column, pop0: Column, pop1: Column) -> Column:
    """Baseline deaths carried over to another population; null if anything is null or pop0 is not positive."""
    return F.when(pop0 > 0, deaths / pop0 * pop1)


def excess_deaths(adjusted: Column, af: Column) -> Column:
    return adjusted * af


def deaths_per_cell(deaths: Column, area_ha: Column, resolution_m: float) -> Column:
    """Deaths of an area, spread evenly over its cells."""
    return F.when(area_ha > 0, deaths / (area_ha * 10_000) * resolution_m**2)
