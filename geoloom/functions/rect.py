"""Query rectangles and the two predicates that sources use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryRect:
    """A rectangle of a query. Time is carried along but never filtered on."""

    x1: float
    y1: float
    x2: float
    y2: float
    projection: str = "EPSG:4326"
    start: float | None = None
    end: float | None = None

    @classmethod
    def from_json(cls, query: dict) -> QueryRect:
        space, time = query["spatial_reference"], query.get("temporal_reference") or {}
        return cls(*(float(space[k]) for k in ("x1", "y1", "x2", "y2")), space.get("projection", "EPSG:4326"), time.get("start"), time.get("end"))


def inside_closed(x: Column, y: Column, rect: QueryRect) -> Column:
    """Inside or on the edge. Reversed bounds hold nothing; null coordinates are outside."""
    return x.between(rect.x1, rect.x2) & y.between(rect.y1, rect.y2)


def inside_open(x: Column, y: Column, rect: QueryRect) -> Column:
    """Inside and not on the edge; null coordinates are outside."""
    return (x > rect.x1) & (x < rect.x2) & (y > rect.y1) & (y < rect.y2)
