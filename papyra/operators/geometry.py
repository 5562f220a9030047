"""Matrices, boxes and quads as column expressions. A matrix is six columns a to f: x' = a x + c y + e,
y' = b x + d y + f; a box is x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = tuple[Column, Column, Column, Column, Column, Column]
Box = tuple[Column, Column, Column, Column]


def matrix(*values) -> Matrix:
    return tuple(v if isinstance(v, Column) else F.lit(float(v)) for v in values)


def concat(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
            m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def apply(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def determinant(m: Matrix) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inverse(m: Matrix) -> Matrix:
    """Null where there is none."""
    det = determinant(m)
    ok = lambda v: F.when(det != 0, v / det)
    return ok(m[3]), ok(-m[1]), ok(-m[2]), ok(m[0]), ok(m[2] * m[5] - m[3] * m[4]), ok(m[1] * m[4] - m[0] * m[5])


def rotation(degrees: Column) -> Matrix:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c, s, -s, c, F.lit(0.0), F.lit(0.0)


def mean_scale(m: Matrix) -> Column:
    return F.sqrt(F.abs(determinant(m)))


def angle(m: Matrix) -> Column:
    return F.degrees(F.atan2(m[1], m[0]))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    """Corners in any order, as least and greatest."""
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def intersect(a: Box, b: Box) -> Box:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def degenerate(a: Box) -> Column:
    return (a[2] <= a[0]) | (a[3] <= a[1])


def inflate(a: Box, by: Column) -> Box:
    return a[0] - by, a[1] - by, a[2] + by, a[3] + by


def under(m: Matrix, a: Box) -> Box:
    """The box around a box's corners under a matrix."""
    points = [apply(m, x, y) for x in (a[0], a[2]) for y in (a[1], a[3])]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def placement(width: Column, height: Column, turn: Column, scale: Column) -> Matrix:
    """Page space (from the lower left) to pixels (from the upper left), turned by quarters."""
    q = F.pmod(F.floor(turn / 90), F.lit(4))
    pick = lambda *v: F.when(q == 0, v[0]).when(q == 1, v[1]).when(q == 2, v[2]).otherwise(v[3])
    zero = F.lit(0.0)
    return (
        pick(scale, zero, -scale, zero), pick(zero, scale, zero, -scale), pick(zero, scale, zero, -scale), pick(-scale, zero, scale, zero),
        pick(zero, zero, width * scale, height * scale), pick(height * scale, zero, zero, width * scale),
    )


def union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def normalised_quad(quad: Column) -> Column:
    """Eight numbers as four points: top left, top right, bottom left, bottom right."""
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((-F.element_at(quad, 2 * i + 2)).alias("down"), F.element_at(quad, 2 * i + 1).alias("x")))
    by_height = F.array_sort(points)
    half = lambda start: F.array_sort(F.transform(F.slice(by_height, start, 2), lambda p: F.struct(p["x"].alias("x"), p["down"].alias("down"))))
    return F.flatten(F.transform(F.concat(half(1), half(3)), lambda p: F.array(p["x"], -p["down"])))


def inside(points: Column, x: Column, y: Column) -> Column:
    """Whether a polygon (an array of structs x, y) holds a point, by the even-odd rule."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, F.pmod(i + 1, n))
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return F.when(n < 3, F.lit(False)).otherwise(F.size(hits) % 2 == 1)


def cells(a: Box, side: float) -> Column:
    """The cells of a grid that a box touches, as an array of structs (cx, cy)."""
    at = lambda v: F.floor(v / side)
    xs, ys = F.sequence(at(a[0]), at(a[2])), F.sequence(at(a[1]), at(a[3]))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def hits(points: DataFrame, boxes: DataFrame, keys: list[str], side: float) -> DataFrame:
    """points (keys, x, y, ...) and boxes (keys, x0, y0, x1, y1, ...) that hold them: an equi-join on the
    cells of a grid with this side, about as wide as a box, then the comparison."""
    grid = boxes.withColumn("cell", F.explode(cells(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), side)))
    placed = points.withColumn("cell", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    return placed.join(grid, [*keys, "cell"]).where("x between x0 and x1 and y between y0 and y1").drop("cell")


def overlapping(boxes: DataFrame, keys: list[str], name: str, side: float) -> DataFrame:
    """Pairs (a < b by name) of boxes of one key that overlap, met in the cells of a grid."""
    one = boxes.select(*keys, F.struct(*boxes.columns).alias("a"), F.explode(cells(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), side)).alias("cell"))
    met = one.join(one.withColumnRenamed("a", "b"), [*keys, "cell"]).where(F.col("a")[name] < F.col("b")[name])
    met = met.where("a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1")
    # a pair meets in several cells; the one with both lower-left corners' greater one counts
    first = F.struct(F.floor(F.greatest("a.x0", "b.x0") / side).alias("cx"), F.floor(F.greatest("a.y0", "b.y0") / side).alias("cy"))
    return met.where(F.col("cell") == first).select(*keys, F.col("a")[name].alias("a"), F.col("b")[name].alias("b"))
