"""Points and pixels in polygons, exactly, by equality joins.

Polygons are vertex rows (key, ring, seq, lon, lat): parts and holes are rings,
closed or not, and a place is inside where a ray from it crosses an odd number
of edges. An edge that ends on the ray counts once (its lower end belongs to
it). Nothing here compares every place with every polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NEAR = 1e-9  # a cell's share by which the cells of an edge are widened; more cells than needed only mean more exact tests


def edges_of(polygons: DataFrame, key: str) -> DataFrame:
    """key, x1, y1, x2, y2 of every edge; the last vertex of a ring meets its first. Vertices without finite coordinates do not count."""
    whole = W.partitionBy(key, "ring").orderBy("seq")
    every = whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = polygons.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select(key, "ring", "seq", F.col("lon").cast("double").alias("x1"), F.col("lat").cast("double").alias("y1"))
    nxt = lambda c: F.coalesce(F.lead(c).over(whole), F.first(c).over(every))
    return v.select(key, "x1", "y1", nxt("x1").alias("x2"), nxt("y1").alias("y2")).where("x1 <> x2 OR y1 <> y2")


def crosses(y: Column) -> Column:
    return (F.col("y1") <= y) != (F.col("y2") <= y)


def crossing(y: Column) -> Column:
    """Where an edge that is not level has height y."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def spans(crossings: DataFrame, *keys: str) -> DataFrame:
    """keys, x_from, x_to: what lies inside on each line, from the places x at which edges cross it."""
    line = W.partitionBy(*keys).orderBy("x")
    paired = crossings.select(*keys, "x", F.lead("x").over(line).alias("x_to"), F.row_number().over(line).alias("_n"))
    return paired.where("_n % 2 = 1 AND x < x_to").select(*keys, F.col("x").alias("x_from"), "x_to")


def strips(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with each strip of cells (cy) that they reach, so that a large polygon is spread over its strips."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.withColumn("cy", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))


def cover(edges: DataFrame, key: str, cell: float) -> DataFrame:
    """key, cx, cy and inside: true for cells that lie in the polygon, null for those on its border."""
    cut = strips(edges, cell)
    clip = lambda y: F.least(F.greatest(F.col(y), F.col("cy") * cell), (F.col("cy") + 1) * cell)
    at = lambda end: F.when(F.col("y1") == F.col("y2"), F.col(f"x{end}")).otherwise(crossing(clip(f"y{end}")))
    a, b = F.least(at("1"), at("2")) / cell, F.greatest(at("1"), at("2")) / cell
    border = cut.select(key, "cy", F.explode(F.sequence(F.floor(a - NEAR), F.floor(b + NEAR))).alias("cx")).distinct()
    middle = (F.col("cy") + 0.5) * cell
    inner = spans(cut.where(crosses(middle)).select(key, "cy", crossing(middle).alias("x")), key, "cy")
    first, last = F.ceil(F.col("x_from") / cell), F.floor(F.col("x_to") / cell) - 1
    full = inner.where(first <= last).select(key, "cy", F.explode(F.sequence(first, last)).alias("cx")).join(border, [key, "cx", "cy"], "left_anti")
    return full.select(key, "cx", "cy", F.lit(True).alias("inside")).unionByName(border.select(key, "cx", "cy", F.lit(None).cast("boolean").alias("inside")))


def points_in(points: DataFrame, polygons: DataFrame, key: str, id_: str = "id", cell: float = 0.25) -> DataFrame:
    """(id, key) of every point in a polygon; points: id (unique), lon, lat. A point may lie in several polygons or in none.

    Points meet the cover by cell. Inside cells need no test; a point in a border cell meets the edges of that polygon in
    its own strip, and their crossings to its right are counted.
    """
    edges = edges_of(polygons, key)
    p = points.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").select(id_, F.col("lon").cast("double").alias("px"), F.col("lat").cast("double").alias("py"))
    p = p.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    met = p.join(cover(edges, key, cell), ["cx", "cy"])
    sure = met.where("inside").select(id_, key)
    tested = met.where("inside IS NULL").select(id_, key, "px", "py", "cy").join(strips(edges, cell), [key, "cy"])
    right = crosses(F.col("py")) & (crossing(F.col("py")) > F.col("px"))
    odd = tested.groupBy(id_, key).agg(F.count_if(right).alias("_n")).where("_n % 2 = 1")
    return sure.unionByName(odd.select(id_, key))


def masked_pixels(pixels: DataFrame, polygons: DataFrame, key: str, affine: tuple[float, float, float, float], block: int = 256) -> DataFrame:
    """Pixels (row, col, ...) whose centre lies in a polygon, with its key; affine: x and y of the upper left corner, width and height (negative downwards) of a pixel.

    Each polygon is cut into spans on the rows' centre lines, spans into blocks of columns; pixels meet those by row and block.
    """
    x0, y0, dx, dy = affine
    edges = edges_of(polygons, key)
    line = lambda y: (y - F.lit(y0)) / F.lit(dy) - 0.5
    a, b = line(F.least("y1", "y2")), line(F.greatest("y1", "y2"))
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least(a, b)), F.ceil(F.greatest(a, b)))))
    y = F.lit(y0) + (F.col("row") + 0.5) * F.lit(dy)
    inner = spans(rows.where(crosses(y)).select(key, "row", crossing(y).alias("x")), key, "row")
    c, d = (F.col("x_from") - x0) / dx, (F.col("x_to") - x0) / dx
    blocks = F.sequence(F.floor((F.floor(F.least(c, d)) - 1) / block), F.floor((F.ceil(F.greatest(c, d)) + 1) / block))
    cut = inner.select(key, F.col("row").alias("_row"), "x_from", "x_to", F.explode(blocks).alias("_block"))
    x = F.lit(x0) + (F.col("col") + 0.5) * F.lit(dx)
    met = pixels.withColumn("_b", F.floor(F.col("col") / block)).join(cut, (F.col("row") == F.col("_row")) & (F.col("_b") == F.col("_block")))
    return met.where((x >= F.col("x_from")) & (x < F.col("x_to"))).select(key, *pixels.columns)


def polygon_tensors(pixels: DataFrame, polygons: DataFrame, key: str, affine: tuple[float, float, float, float], nodata: float | None = None) -> DataFrame:
    """One row per polygon with a valid pixel: tight bounds in rows and columns and in coordinates, shape, counts and values row by row; what is outside, or missing, is 0."""
    from .spatial import county_tensors

    x0, y0, dx, dy = affine
    value = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    inside = masked_pixels(pixels.withColumn("value", value), polygons, key, affine)
    box = inside.where("value IS NOT NULL AND NOT isnan(value)").groupBy(key).agg(F.min("row").alias("_t"), F.max("row").alias("_b"), F.min("col").alias("_l"), F.max("col").alias("_r"))
    # the rectangle's other pixels count as missing, as in an array with a mask
    cells = box.select(key, F.explode(F.sequence("_t", "_b")).alias("row"), "_l", "_r").select(key, "row", F.explode(F.sequence("_l", "_r")).alias("col"))
    filled = cells.join(inside.select(key, "row", "col", "value"), [key, "row", "col"], "left")
    out = county_tensors(filled, [key])
    corner = lambda o, n, step: F.lit(o) + n * F.lit(step)
    return out.withColumns({"bounds_left": corner(x0, F.col("left"), dx), "bounds_top": corner(y0, F.col("top"), dy), "bounds_right": corner(x0, F.col("left") + F.col("width"), dx), "bounds_bottom": corner(y0, F.col("top") + F.col("height"), dy)})
