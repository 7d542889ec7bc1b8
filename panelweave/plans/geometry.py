"""Polygons over points and pixels on the driver's tables: each nation a star with a hole, every other one with a second part, one without any vertex."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons as P
from . import base as B
from .registry import query

#: Rings as offsets from a nation's centre: the star, its hole, the second part.
RINGS = (
    ((0, 4), (1, 1), (5, 2), (2, -1), (3, -5), (0, -2), (-3, -5), (-2, -1), (-5, 2), (-1, 1)),
    ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)),
    ((4, 4), (6, 4), (6, 6), (4, 6), (4, 4)),
)
OFFSETS = [(ring, seq, float(x), float(y)) for ring, vertices in enumerate(RINGS) for seq, (x, y) in enumerate(vertices)]
SIZE = [len(r) for r in RINGS]
AFFINE = (-130.0, 55.0, 0.4, -0.25)
ROWS, COLUMNS = 130, 190

POINTS = "points AS (SELECT c_custkey AS id, -130 + (c_custkey * 37 % 7000) / 100.0::DOUBLE AS lon, 20 + (c_custkey * 91 % 3300) / 100.0::DOUBLE AS lat FROM customer)"
EDGES = f"""v AS (SELECT n_nationkey AS nation, ring, seq, (-125 + n_nationkey % 5 * 12 + dx)::DOUBLE AS x, (26 + n_nationkey // 5 * 5 + dy)::DOUBLE AS y FROM nation, (VALUES {', '.join(f'({r}, {s}, {x}::DOUBLE, {y}::DOUBLE)' for r, s, x, y in OFFSETS)}) AS t(ring, seq, dx, dy)
  WHERE n_nationkey <> 7 AND (ring < 2 OR n_nationkey % 2 = 0)),
 edges AS (SELECT a.nation, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.nation = b.nation AND a.ring = b.ring AND b.seq = (a.seq + 1) % (CASE a.ring WHEN 0 THEN {SIZE[0]} WHEN 1 THEN {SIZE[1]} ELSE {SIZE[2]} END))"""
INSIDE = "(y1 <= {y}) <> (y2 <= {y}) AND x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) > {x}"


def polygons(s, d):
    offsets = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(q).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for r, q, x, y in OFFSETS])
    n = B.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("nation"), F.explode(offsets).alias("o")).where("nation <> 7 AND (o.ring < 2 OR nation % 2 = 0)")
    return n.select("nation", "o.ring", "o.seq", (F.lit(-125.0) + F.col("nation") % 5 * 12 + F.col("o.dx")).alias("lon"), (F.lit(26.0) + F.floor(F.col("nation") / 5) * 5 + F.col("o.dy")).alias("lat"))


@query(f"WITH {POINTS}, {EDGES} SELECT id, nation::INT AS nation FROM points, edges GROUP BY id, nation HAVING count(*) FILTER ({INSIDE.format(x='lon', y='lat')}) % 2 = 1")
def points_in_polygons(s, d):
    k = F.col("c_custkey")
    points = B.table(s, d, "customer").select(k.alias("id"), (-130 + (k * 37 % 7000) / 100).alias("lon"), (20 + (k * 91 % 3300) / 100).alias("lat"))
    return P.points_in(points, polygons(s, d), "nation")


PIXELS = f"""pixels AS (SELECT CAST(l_orderkey % {ROWS} AS INT) AS "row", CAST((l_partkey * 7 + l_linenumber) % {COLUMNS} AS INT) AS col, sum(l_quantity::BIGINT) % 50 AS value FROM lineitem GROUP BY ALL)"""


def pixels(s, d):
    line = B.table(s, d, "lineitem")
    keys = (F.col("l_orderkey") % ROWS).cast("int").alias("row"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % COLUMNS).cast("int").alias("col")
    return line.groupBy(*keys).agg((F.sum(F.col("l_quantity").cast("long")) % 50).cast("double").alias("value"))


@query(f"""WITH {PIXELS}, {EDGES}, inside AS (SELECT nation, "row", col, any_value(value) AS value FROM (SELECT *, {AFFINE[0]} + (col + 0.5::DOUBLE) * {AFFINE[2]} AS px, {AFFINE[1]} + ("row" + 0.5::DOUBLE) * {AFFINE[3]} AS py FROM pixels), edges
  GROUP BY nation, "row", col HAVING count(*) FILTER ({INSIDE.format(x='px', y='py')}) % 2 = 1)
 SELECT nation::INT AS nation, CAST(max("row") - min("row") + 1 AS INT) AS height, CAST(max(col) - min(col) + 1 AS INT) AS width, count(*) AS valid_pixels, min("row") AS top, min(col) AS "left", CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * ("row" * 7 + col)) AS BIGINT) AS placed
 FROM inside WHERE value <> 13 GROUP BY nation""")
def polygon_tensor_bounds(s, d):
    t = P.polygon_tensors(pixels(s, d), polygons(s, d), "nation", AFFINE, 13.0)
    place = F.transform("values", lambda v, i: (v.cast("double") * ((F.col("top") + F.floor(i / F.col("width"))) * 7 + F.col("left") + i % F.col("width"))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")).cast("long")
    return t.select("nation", "height", "width", "valid_pixels", "top", "left", total(F.col("values")).alias("total"), total(place).alias("placed"))
