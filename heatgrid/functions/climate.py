"""Humidity and heat-stress arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnus_kpa(celsius: Column) -> Column:
    """Saturation vapour pressure."""
    return 0.6112 * F.exp(17.67 * celsius / (celsius + 243.5))


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def relative_humidity(temperature: Column, dew_point: Column) -> Column:
    """Percent, from temperature and dew point in degrees C."""
    return 100 * magnus_kpa(dew_point) / magnus_kpa(temperature)


def vapour_pressure_deficit(temperature: Column, dew_point: Column) -> Column:
    return magnus_kpa(temperature) - magnus_kpa(dew_point)


def workability(wbgt: Column, alpha1: float = 30.94, alpha2: float = 16.64) -> Column:
    """Share of an hour that can be worked at a wet-bulb globe temperature."""
    return 0.1 + 0.9 / (1 + F.pow(wbgt / alpha1, F.lit(alpha2)))
