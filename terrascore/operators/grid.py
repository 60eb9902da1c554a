"""Grid cells on the globe as numbers: rows run south to north, columns from -180 degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrascore.functions.geo import haversine_km


def cell_of(lat: Column, lon: Column, size: float) -> Column:
    """The cell of a position; the last row and column take in their outer edge."""
    columns = round(360 / size)
    row = F.least(F.floor((lat + 90) / size), F.lit(round(180 / size) - 1))
    col = F.least(F.floor((lon + 180) / size), F.lit(columns - 1))
    return (row * columns + col).cast("bigint")


def cell_corner(cell: Column, size: Column) -> tuple[Column, Column]:
    """South-west corner of a cell; the size may vary by row."""
    columns = F.round(F.lit(360.0) / size).cast("bigint")
    return F.floor(cell / columns) * size - 90, cell % columns * size - 180


def cell_box(cell: Column, size: float | Column) -> tuple[Column, Column, Column]:
    """Centre of a cell and a radius in km that covers it."""
    size = F.lit(size)
    south, west = cell_corner(cell, size)
    lat, lon = south + size / 2, west + size / 2
    low = haversine_km(lat, lon, lat - size / 2, lon - size / 2)
    high = haversine_km(lat, lon, lat + size / 2, lon - size / 2)
    return lat, lon, F.greatest(low, high) + 1e-6
