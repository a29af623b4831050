"""A store of places ordered along a space-filling curve, and reads that only open what a circle or a corridor covers.

Places are written in the order of the Z-curve over their Mercator coordinates, in files and row groups of neighbouring places. A read covers its area with
ranges of the curve, so that files and row groups outside of them are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Half the width of the plane, bits of a coordinate, and so the metres that the curve tells apart.
HALF, BITS = 20037508.342789244, 22
STEP = 2 * HALF / (1 << BITS)
#: Ranges of a read at most; further cells are left joined with what is between them.
MOST_RANGES = 16


def _spread(v: Column) -> Column:
    """Bits of a number with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _step(v: Column) -> Column:
    return F.least(F.greatest(F.floor((v + HALF) / STEP), F.lit(0)), F.lit((1 << BITS) - 1))


def curve(x: Column, y: Column) -> Column:
    """The place of a point on the Z-curve. Points off the plane stand at its border."""
    return _spread(_step(x)).bitwiseOR(F.shiftleft(_spread(_step(y)), 1))


def write(places: DataFrame, path: str, files: int, group_rows: int = 20_000) -> None:
    """places (x, y and anything else; rows without coordinates go to the front) in the order of the curve: `files` ranges, row groups of about group_rows."""
    rows = places.withColumn("curve", curve(F.col("x"), F.col("y")))
    rows.repartitionByRange(files, "curve").sortWithinPartitions("curve").write.option("parquet.block.row.count.limit", group_rows).parquet(path)


def ranges(boxes: list[tuple[float, float, float, float]], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve that hold all points of the boxes (west, south, east, north, in metres): a quadtree's cells are split while there are
    few, and the smallest gaps are closed at the end."""
    steps = lambda v: max(0, min((1 << BITS) - 1, int((v + HALF) // STEP)))
    spans = [(steps(w), steps(s), steps(e), steps(n)) for w, s, e, n in boxes]
    found, waiting = [], [(BITS, 0, 0)]
    while waiting:
        level, cx, cy = waiting.pop(0)
        low_x, low_y, size = cx << level, cy << level, 1 << level
        met = [b for b in spans if b[0] < low_x + size and b[2] >= low_x and b[1] < low_y + size and b[3] >= low_y]
        if not met:
            continue
        whole = any(b[0] <= low_x and b[2] >= low_x + size - 1 and b[1] <= low_y and b[3] >= low_y + size - 1 for b in met)
        if whole or level == 0 or len(found) + len(waiting) >= 8 * most:
            at = sum(((low_x >> i & 1) << 2 * i) | ((low_y >> i & 1) << 2 * i + 1) for i in range(BITS))
            found.append((at, at + (1 << 2 * level) - 1))
        else:
            waiting += [(level - 1, 2 * cx + i, 2 * cy + j) for j in (0, 1) for i in (0, 1)]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    while len(joined) > most:
        i = min(range(len(joined) - 1), key=lambda k: joined[k + 1][0] - joined[k][1])
        joined[i : i + 2] = [[joined[i][0], joined[i + 1][1]]]
    return [(a, b) for a, b in joined]


def read(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """The store's places, without the curve; of those in boxes all, and perhaps some around them: exact tests follow."""
    rows = spark.read.parquet(path)
    if boxes is not None:
        wanted = F.lit(False)
        for a, b in ranges(boxes):
            wanted = wanted | F.col("curve").between(a, b)
        rows = rows.where(wanted)
    return rows.drop("curve")


def circle(at: tuple[float, float], radius: float) -> list[tuple[float, float, float, float]]:
    return [(at[0] - radius, at[1] - radius, at[0] + radius, at[1] + radius)]


def corridor(line: list[tuple[float, float]], width: float) -> list[tuple[float, float, float, float]]:
    """Boxes along a line: each segment is cut into pieces no longer than four widths, so that a slanting one isn't covered by one large box."""
    out = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        n = max(1, min(64, int(max(abs(bx - ax), abs(by - ay)) / (4 * width)) + 1))
        for i in range(n):
            x, y = sorted((ax + (bx - ax) * i / n, ax + (bx - ax) * (i + 1) / n)), sorted((ay + (by - ay) * i / n, ay + (by - ay) * (i + 1) / n))
            out.append((x[0] - width, y[0] - width, x[1] + width, y[1] + width))
    return out
