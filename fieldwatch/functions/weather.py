"""Weather formulas: clear sky, bounds of fields, circular differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ["temperature", "humidity_prec", "barometer", "wind_speed", "wind_direction", "hub_voltage", "irradiance"]


def clear_sky(lat: Column, day_of_year: Column, hour: Column) -> Column:
    """Clear-sky irradiance (W/m2) from latitude, day of the year and UTC hour; 0 below the horizon."""
    decl = F.radians(F.lit(23.45) * F.sin(F.radians(F.lit(360.0 / 365.0) * (day_of_year - 81))))
    turn = F.radians(F.lit(15.0) * (hour - 12))
    up = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(turn)
    return F.when(up <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(750.0) * up))


def clip_field(field: Column, value: Column) -> Column:
    """Humidity within 0..100, directions modulo 360, speed and irradiance not negative."""
    return (F.when(field == "humidity_prec", F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))).when(field == "wind_direction", F.pmod(value, F.lit(360.0)))
            .when(field.isin("wind_speed", "irradiance"), F.greatest(F.lit(0.0), value)).otherwise(value))


def circular_diff(a: Column, b: Column) -> Column:
    """Smaller angle between two directions."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)
