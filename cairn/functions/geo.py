"""Planar geometry over longitude and latitude columns; metres are Mercator metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def project(lon: float, lat: float) -> tuple[float, float]:
    """The same on the driver, for a request's own points."""
    return math.radians(lon) * RADIUS, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * RADIUS


def distance(x: Column, y: Column, px: float, py: float) -> Column:
    return F.hypot(x - px, y - py)


def segment_distance(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """From a point to a segment: to the foot of the perpendicular, or to the nearer end."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    if size == 0:
        return distance(x, y, *a)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a[0]) * dx + (y - a[1]) * dy) / size))
    return F.hypot(x - (a[0] + t * dx), y - (a[1] + t * dy))


def line_distance(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    parts = [segment_distance(x, y, a, b) for a, b in zip(line, line[1:], strict=False)]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def in_box(x: Column, y: Column, points: list[tuple[float, float]], margin: float) -> Column:
    """A filter on bare columns, which the Parquet reader can use, before the exact distance."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return x.between(min(xs) - margin, max(xs) + margin) & y.between(min(ys) - margin, max(ys) + margin)


def in_ring(px: Column, py: Column, ring: Column, edges_too: bool = True) -> Column:
    """Whether a point lies in a closed ring (array of struct x, y), by counting crossings to the right; on its edge
    counts as inside or, without edges_too, as outside."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (cross == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > py) != (e["by"] > py)
        at = e["ax"] + (py - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return F.when(spans & (px < at), 1).otherwise(0)

    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1
    return F.exists(edges, on) | odd if edges_too else ~F.exists(edges, on) & odd


def ring_centroid(ring: Column) -> Column:
    """struct x, y: the area-weighted centre of a closed ring; of one without area that of its outline."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    ox, oy = F.get(ring, F.lit(0))["x"], F.get(ring, F.lit(0))["y"]
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("area", "x", "y")))

    def step(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        cross = ax * by - bx * ay
        return F.struct((s["area"] + cross).alias("area"), (s["x"] + (ax + bx) * cross).alias("x"), (s["y"] + (ay + by) * cross).alias("y"))

    sums = F.aggregate(pairs, zero, step)
    area = F.struct((ox + sums["x"] / (3 * F.nullif(sums["area"], F.lit(0.0)))).alias("x"), (oy + sums["y"] / (3 * F.nullif(sums["area"], F.lit(0.0)))).alias("y"))
    return F.when(sums["area"] != 0, area).otherwise(line_centroid(ring))


def line_centroid(line: Column) -> Column:
    """struct x, y: the mean of the segments' middles, weighted by their lengths; of a line without length its first point."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("size", "x", "y")))

    def step(s: Column, e: Column) -> Column:
        size = F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
        return F.struct((s["size"] + size).alias("size"), (s["x"] + (e["ax"] + e["bx"]) / 2 * size).alias("x"), (s["y"] + (e["ay"] + e["by"]) / 2 * size).alias("y"))

    sums = F.aggregate(pairs, zero, step)
    first = F.get(line, F.lit(0))
    size = F.nullif(sums["size"], F.lit(0.0))
    return F.struct(F.coalesce(sums["x"] / size, first["x"]).alias("x"), F.coalesce(sums["y"] / size, first["y"]).alias("y"))
