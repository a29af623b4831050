"""Covers of polygons, and the place store."""

import glob
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.operators import matching, scoring
from cairn.sources import place_store
from cairn.functions import geo


def inside(x, y, ring):
    """Whether a point lies in a closed ring by parity, and whether on its edge."""
    odd = on = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on |= cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd, on


def test_contained_equals_brute_force(spark):
    rng = random.Random(4)
    star = lambda n, r: [(r * (1 + 0.4 * (i % 2)) * math.cos(2 * math.pi * i / n), r * (1 + 0.4 * (i % 2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    shapes = {"star": ([*star(16, 3.0), star(16, 3.0)[0]], [[(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]]), "box": ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], None), "speck": ([(0.1, 0.1), (0.101, 0.1), (0.1, 0.101), (0.1, 0.1)], []), "none": ([], None)}
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(3000)] + [(5000 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 4.0), (4.0, 2.0), (1.0, 0.0), (0.1, 0.1), (-1.0, 1.0), (0.5, 0.5)])]
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    polygons = spark.createDataFrame([(k, ring(r), None if h is None else [ring(x) for x in h]) for k, (r, h) in shapes.items()], "polygon_id string, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    got = sorted((r.polygon_id, r.poi_id) for r in matching.contained(spark.createDataFrame(points, "poi_id int, x double, y double"), polygons, 0.25).select("polygon_id", "poi_id").collect())
    want = []
    for k, (r, holes) in shapes.items():
        for i, x, y in points:
            odd, on = inside(x, y, r)
            if (odd or on) and not any(inside(x, y, h)[0] and not inside(x, y, h)[1] for h in holes or []):
                want.append((k, i))
    assert got == sorted(want)


def test_a_large_polygon_has_few_cells(spark):
    n = 400
    ring = [{"x": 10 * math.cos(2 * math.pi * i / n), "y": 5 * math.sin(2 * math.pi * i / n)} for i in range(n)]
    polygons = spark.createDataFrame([(1, [*ring, ring[0]])], "polygon_id int, ring array<struct<x:double,y:double>>")
    cells = matching.covers(polygons, 0.01).toPandas()
    assert len(cells) < 30_000 and cells.inner.any() and not cells[cells.level > 0].inner.eq(False).any()
    area = (cells.inner * (0.01 * 2.0**cells.level) ** 2).sum()
    assert area < math.pi * 50 < area + len(cells[~cells.inner]) * 0.01**2


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    x, y = geo.project(-105.94, 35.69)
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x + rng.uniform(-2e5, 2e5, 20_000), y + rng.uniform(-2e5, 2e5, 20_000), strict=True))], "poi_id int, x double, y double")
    path = str(tmp_path_factory.mktemp("store") / "places")
    place_store.write(places, path, 16, 200)
    return path, places.toPandas(), (x, y)


def groups(path):
    """Least and largest place on the curve of every row group."""
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [c for c in range(meta.num_columns) if meta.schema.column(c).name == "curve"][0]
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            yield stats.min, stats.max


@pytest.mark.parametrize("kind", ["circle", "corridor"])
def test_reads_open_few_row_groups(spark, store, kind):
    path, places, (x, y) = store
    line = [(x - 90_000, y - 80_000), (x, y + 10_000), (x + 90_000, y + 85_000)]
    boxes = place_store.circle((x, y), 4000) if kind == "circle" else place_store.corridor(line, 2500)
    found = place_store.read(spark, path, boxes)
    inside = np.zeros(len(places), bool)
    for w, s, e, n in boxes:
        inside |= places.x.between(w, e) & places.y.between(s, n)
    got = {r.poi_id for r in found.collect()}
    assert set(places.poi_id[inside]) <= got and found.columns == ["poi_id", "x", "y"]
    wanted, every = place_store.ranges(boxes), list(groups(path))
    opened = sum(any(a <= high and b >= low for a, b in wanted) for low, high in every)
    assert len(every) > 50 and opened < len(every) / (10 if kind == "circle" else 3) and len(wanted) <= place_store.MOST_RANGES
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString() or "PushedFilters: [And(" in found._jdf.queryExecution().toString() or "curve" in found._jdf.queryExecution().executedPlan().toString()
    if kind == "circle":
        near = found.where(geo.distance(F.col("x"), F.col("y"), x, y) <= 4000).count()
        assert near == int((np.hypot(places.x - x, places.y - y) <= 4000).sum())


def test_ranges_of_the_whole_plane():
    assert place_store.ranges([(-3e7, -3e7, 3e7, 3e7)]) == [(0, (1 << 2 * place_store.BITS) - 1)]
