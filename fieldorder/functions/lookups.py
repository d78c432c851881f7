"""Lookups of fixed lists as column expressions (no join, no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv


def mapped(key: Column, values: Mapping, default=None) -> Column:
    """values[key], or the default."""
    found = F.try_element_at(F.create_map(*[F.lit(v) for v in chain(*values.items())]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def place_points(position: Column, table: Sequence[int]) -> Column:
    """Points of a place; 0 beyond the table or without a place."""
    p = F.when(position >= 1, position.cast("int"))
    return F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in table]), p), F.lit(0))


def race_points(position: Column) -> Column:
    return place_points(position, fv.RACE_POINTS)


def sprint_points(position: Column, year: Column) -> Column:
    early = place_points(position, fv.SPRINT_POINTS_TO_2021)
    return F.when(year <= 2021, early).otherwise(place_points(position, fv.SPRINT_POINTS))


def venue_type(venue: Column) -> Column:
    flat = {v: kind for kind, venues in fv.VENUE_TYPES.items() for v in venues}
    return mapped(venue, flat, fv.VENUE_TYPE_DEFAULT)


def is_street(venue: Column) -> Column:
    return F.coalesce(F.lower(venue).isin(fv.STREET_VENUES), F.lit(False)).cast("double")


def safety_car_rate(venue: Column) -> Column:
    return mapped(F.lower(venue), fv.SAFETY_CAR_RATE, fv.SAFETY_CAR_DEFAULT)


def grid_bin(grid: Column) -> Column:
    return (
        F.when(grid == 1, "P1")
        .when(grid == 2, "P2")
        .when(grid == 3, "P3")
        .when(grid <= 6, "P4-6")
        .when(grid <= 10, "P7-10")
        .when(grid <= 15, "P11-15")
        .otherwise("P16+")
    )
