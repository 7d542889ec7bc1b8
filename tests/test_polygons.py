"""Polygons against a plain ray test of every place with every edge."""

import random

import pytest

from panelweave.operators import polygons as P

VERTEX = "k string, ring int, seq int, lon double, lat double"


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(4)
    shapes = {
        "square with hole": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]],
        "two parts": [[(5, 5), (6, 5), (6, 6), (5, 6), (5, 5)], [(8, 1), (9, 3), (7, 3)]],
        "sliver": [[(0.1, 9.01), (9.9, 9.02), (9.9, 9.03)]],
        "large": [[(-40, -40), (50, -38), (45, 60), (-30, 55)]],
        "far away": [[(100, 100), (101, 100), (101, 101)]],
    } | {f"random {i}": [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))] for i in range(15)}
    rows = [(k, r, s, float(x), float(y)) for k, rings in shapes.items() for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    rows += [("empty", 0, 0, None, 1.0), ("point", 0, 0, 2.0, 2.0), ("line", 0, 0, 1.0, 1.0), ("line", 0, 1, 5.0, 5.0)]
    rng.shuffle(rows)
    return shapes, spark.createDataFrame(rows, VERTEX)


@pytest.mark.parametrize("cell", [0.3, 1.0, 7.0])
def test_points(spark, shapes, cell):
    rng = random.Random(2)
    plain, table = shapes
    points = [(i, rng.uniform(-1, 11), rng.uniform(-1, 11)) for i in range(500)] + [(1000 + i, float(i % 12), float(i // 12)) for i in range(120)]
    rows = spark.createDataFrame([*points, (5000, None, 1.0), (5001, float("nan"), 1.0)], "id long, lon double, lat double")
    want = sorted((i, k) for i, x, y in points for k, rings in plain.items() if inside(rings, x, y))
    assert sorted(map(tuple, P.points_in(rows, table, "k", "id", cell).collect())) == want


@pytest.mark.parametrize(("affine", "block"), [((-1.0, 11.0, 0.5, -0.5), 4), ((0.0, 0.0, 0.25, 0.25), 256)])
def test_pixels(spark, shapes, affine, block):
    plain, table = shapes
    x0, y0, dx, dy = affine
    pixels = [(r, c, float((r * 31 + c * 7) % 5)) for r in range(24) for c in range(26)]
    df = spark.createDataFrame(pixels, "row int, col int, value double")
    want = sorted((k, r, c, v) for r, c, v in pixels for k, rings in plain.items() if inside(rings, x0 + (c + 0.5) * dx, y0 + (r + 0.5) * dy))
    assert sorted(map(tuple, P.masked_pixels(df, table, "k", affine, block).collect())) == want
    got = {r.k: r for r in P.polygon_tensors(df, table, "k", affine, 3.0).collect()}
    assert set(got) == {k for k, *_, v in want if v != 3}
    for k, row in got.items():
        own = {(r, c): v for q, r, c, v in want if q == k and v != 3}
        top, left = min(r for r, _ in own), min(c for _, c in own)
        assert (row.top, row.left, row.valid_pixels) == (top, left, len(own))
        assert list(row["values"]) == [own.get((top + i // row.width, left + i % row.width), 0.0) for i in range(row.height * row.width)]
        assert row.bounds_left == pytest.approx(x0 + left * dx) and row.bounds_bottom == pytest.approx(y0 + (top + row.height) * dy)


def test_plans_have_no_product_of_rows(spark, shapes):
    points = spark.createDataFrame([(1, 2.0, 2.0)], "id long, lon double, lat double")
    plan = P.points_in(points, shapes[1], "k")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
