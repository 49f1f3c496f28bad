"""Distances and boosts on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_vector(lat: Column, lon: Column) -> Column:
    return F.struct((F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z"))


def chord(km: float) -> float:
    """Length of the chord under an arc."""
    return 2 * math.sin(min(km / RADIUS_KM, math.pi) / 2)


def decay(km: Column, half: float = 25.0, most: float = 0.18) -> Column:
    """Halves with every ``half`` kilometres."""
    return most * F.pow(F.lit(2.0), -km / half)


def boost(km: Column, radius: float, confidence: Column) -> Column:
    """Nothing beyond twice the radius."""
    return F.when(km > 2 * radius, F.lit(0.0)).otherwise(decay(km, radius / 2) * F.least(F.lit(1.0), confidence))


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Grid cell of a point."""
    return F.floor(lat / degrees).cast("int"), F.floor(lon / degrees).cast("int")
