"""Boxes, points and rings as plain columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Box:
    """Names of the four columns of a box."""

    xmin: str = "xmin"
    ymin: str = "ymin"
    xmax: str = "xmax"
    ymax: str = "ymax"

    @property
    def names(self) -> tuple[str, str, str, str]:
        return self.xmin, self.ymin, self.xmax, self.ymax


def pixel_to_world(px, py, left, top, resolution) -> tuple[Column, Column]:
    """Column and row of a raster to coordinates."""
    return _c(left) + _c(px) * resolution, _c(top) - _c(py) * resolution


def world_to_pixel(x, y, left, top, resolution) -> tuple[Column, Column]:
    """Coordinates to column and row, halves to even, rows downwards."""
    return F.bround((_c(x) - _c(left)) / resolution).cast("bigint"), F.bround((_c(top) - _c(y)) / resolution).cast("bigint")


def expand_to(low, high, size: float) -> tuple[Column, Column]:
    """Widen an extent evenly to ``size`` if it is smaller."""
    extra = F.greatest(F.lit(0.0), F.lit(float(size)) - (_c(high) - _c(low))) / 2
    return _c(low) - extra, _c(high) + extra


def pad(low, high, margin: float) -> tuple[Column, Column]:
    """A fixed margin on both ends."""
    return _c(low) - margin, _c(high) + margin


def square(x, y, half: float) -> list[Column]:
    """Envelope of a buffer around a point: xmin, ymin, xmax, ymax."""
    return [_c(x) - half, _c(y) - half, _c(x) + half, _c(y) + half]


def centroid(box: Box = Box()) -> tuple[Column, Column]:
    """Centre of a box."""
    return (F.col(box.xmin) + F.col(box.xmax)) / 2, (F.col(box.ymin) + F.col(box.ymax)) / 2


def distance(x1, y1, x2, y2) -> Column:
    """Plane distance."""
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def translated(box: Box, dx: float, dy: float) -> list[Column]:
    """The box moved."""
    return [F.col(box.xmin) + dx, F.col(box.ymin) + dy, F.col(box.xmax) + dx, F.col(box.ymax) + dy]


def ring_envelope(ring) -> list[Column]:
    """Xmin, ymin, xmax, ymax of a ring of (x, y) vertices."""
    xs, ys = F.transform(_c(ring), lambda p: p["x"]), F.transform(_c(ring), lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def raster_extent(left, top, rows, cols, resolution) -> list[Column]:
    """Xmin, ymin, xmax, ymax of a raster from its top left corner, shape and resolution."""
    return [_c(left), _c(top) - _c(rows) * resolution, _c(left) + _c(cols) * resolution, _c(top)]


def box_area(box: Box = Box()) -> Column:
    """Area of a box."""
    return (F.col(box.xmax) - F.col(box.xmin)) * (F.col(box.ymax) - F.col(box.ymin))


def _edges(ring: Column) -> Column:
    """Vertices paired with the next one, around the end."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def ring_area(ring) -> Column:
    """Area of a ring (shoelace)."""
    twice = F.aggregate(_edges(_c(ring)), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(twice) / 2


def point_in_ring(x, y, ring) -> Column:
    """Ray casting; points on an edge count as inside."""
    x, y = _c(x), _c(y)

    def crossing(e):
        straddles = (e["y1"] > y) != (e["y2"] > y)
        return F.when(straddles & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0)

    def on(e):
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        within = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (cross == 0) & within

    edges = _edges(_c(ring))
    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + crossing(e)) % 2 == 1
    return odd | F.exists(edges, on)


def ring_crosses(xmin: Column, ymin: Column, xmax: Column, ymax: Column, ring) -> Column:
    """An edge of a ring touches, crosses or lies in a box."""

    def crosses(e):
        # an edge meets the box: its extent overlaps, and the corners aren't all strictly on one side of its line
        apart = (F.greatest(e["x1"], e["x2"]) < xmin) | (F.least(e["x1"], e["x2"]) > xmax) | (F.greatest(e["y1"], e["y2"]) < ymin) | (F.least(e["y1"], e["y2"]) > ymax)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        sides = [side(x, y) for x in (xmin, xmax) for y in (ymin, ymax)]
        return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(_edges(_c(ring)), crosses)


def box_meets_ring(box: Box, ring) -> Column:
    """A box touches, crosses, holds or lies in a ring. Touching counts."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in box.names)
    return point_in_ring(xmin, ymin, ring) | ring_crosses(xmin, ymin, xmax, ymax, ring)


def literal_ring(points) -> Column:
    """A ring known to the caller as a constant column."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
