"""Distances and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def dist2(a: str, b: str, metric: str = "l2") -> Column:
    """Squared Euclidean distance ("l2") or sum of absolute differences ("l1") between two aliased frames' points."""
    parts = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    if metric == "l1":
        parts = [F.abs(p) for p in parts]
    elif metric == "l2":
        parts = [p * p for p in parts]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return parts[0] + parts[1] + parts[2]


def cell(value: Column, width) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(value / width).cast("long")


def around(columns: list[Column], reach: int = 1) -> Column:
    """All cells within ``reach`` of a cell, as an array of structs (cx, cy, cz)."""
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct((columns[0] + i).alias("cx"), (columns[1] + j).alias("cy"), (columns[2] + k).alias("cz")) for i in steps for j in steps for k in steps])
