import gzip
import io
import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import spatial as S
from panelweave.operators.relational import keep_last
from panelweave.sources import binary, files, sinks


def test_text_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(" Series_ID \tvalue\nx\t1\ny\t2\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(" Series_ID \tvalue\nx\t3\n")
    df = files.read_tsv(spark, str(tmp_path))
    assert df.columns == ["series_id", "value", "seq"] and dict(df.dtypes)["value"] == "string"
    assert {r.series_id: r.value for r in keep_last(df, ["series_id"], "seq").collect()} == {"x": "3", "y": "2"}
    (tmp_path / "l.csv").write_bytes("n\nDoña\n".encode("latin-1"))
    assert files.read_latin1(spark, str(tmp_path / "l.csv")).first().n == "Doña"
    (tmp_path / "g.tsv").write_text("GEOID\tINTPTLAT\tINTPTLONG \n1001\t32.5\t-86.6\n1003\tx\t1\n")
    assert [tuple(r) for r in files.coordinates(spark.read.csv(str(tmp_path / "g.tsv"), sep="\t", header=True)).collect()] == [("01001", 32.5, -86.6)]
    assert files.discover(str(tmp_path), ["*.shp", "*.csv"]).endswith("l.csv") and files.discover(str(tmp_path), ["*.xyz"]) is None
    assert files.for_year(["a_2020.zip", "a_12020.zip", "b2021.zip"], 2020) == ["a_2020.zip"]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.json")


def test_parquet_and_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2020, "a", 1.0), (2021, "b", 2.0)], "year int, k string, v double")
    sinks.overwrite_by(df, path, "year")
    assert files.read_parquet(spark, path, ["k"], F.col("year") == 2021).first().k == "b"
    path = str(tmp_path / "u")
    assert sinks.append_new(df, path, ["year"]).count() == 2 and sinks.append_new(df, path, ["year"]).count() == 0
    more = df.unionByName(spark.createDataFrame([(2022, "c", 3.0)], df.schema))
    assert sinks.append_new(more, path, ["year"]).first().k == "c" and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="partly"):
        sinks.append_new(more, path, ["year"], spark.createDataFrame([(2020, 2)], "year int, n int"))
    with pytest.raises(ValueError, match="schema"):
        sinks.append_checked(df.withColumn("v", F.lit("x")), path)
    assert files.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.write_json({"b": 1, "a": [1]}, str(tmp_path / "r" / "x.json"))
    assert files.read_json(str(tmp_path / "r" / "x.json")) == {"a": [1], "b": 1} and files.read_json(str(tmp_path / "no.json"), False) == {}
    assert files.read_runs(str(tmp_path / "r"), ["a"], b=1) and not files.read_runs(str(tmp_path / "r"), ["z"])
    assert sinks.markdown(df.orderBy("year")).split("\n")[2] == "| 2020 | a | 1.0000 |"


def workbook(cells, shared):
    rows = {}
    for ref, kind, text in cells:
        rows.setdefault(int("".join(c for c in ref if c.isdigit())), []).append(f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>' if kind == "i" else f'<c r="{ref}"{" t=" + chr(34) + "s" + chr(34) if kind == "s" else ""}><v>{text}</v></c>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">{"".join(c)}</row>' for n, c in sorted(rows.items())) + "</sheetData></worksheet>")
    return f.getvalue()


def test_xlsx(spark, tmp_path):
    cells = [("A3", "s", "0"), ("C4", "n", "2010"), ("D4", "n", "2011"), ("A5", "i", ".Adams County, Ohio"), ("C5", "i", "1,234"), ("D5", "n", "5"), ("A6", "i", "Ohio"), ("C6", "n", "9"), ("A7", "i", "Note: end"), ("A8", "i", ".Late County, Ohio"), ("C8", "n", "7")]
    (tmp_path / "w.xlsx").write_bytes(workbook(cells, ["Geographic Area"]))
    got = binary.area_series(binary.read_xlsx(spark, str(tmp_path / "w.xlsx"))).collect()
    assert sorted((r.area, r.year, r.value) for r in got) == [("Adams County, Ohio", 2010, 1234.0), ("Adams County, Ohio", 2011, 5.0)]
    assert [binary.column_number(c) for c in ("A1", "Z9", "AA3", "AB7")] == [0, 25, 26, 27]


def dbf(names, rows, width=12):
    size = 1 + width * len(names)
    head = 32 + 32 * len(names) + 1
    out = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(rows), head, size)
    out += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for n in names) + b"\r"
    return out + b"".join((b"*" if r[0] == "gone" else b" ") + b"".join(v.encode("latin-1").ljust(width) for v in r) for r in rows)


def shp(shapes):
    out = b"\0" * 100
    for i, rings in enumerate(shapes):
        pts = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return out


def test_shapes(spark, tmp_path):
    (tmp_path / "a.dbf").write_bytes(dbf(["GEOID", "NAME"], [("01001", "Año"), ("gone", "x"), ("01003", "")]))
    got = binary.fields(binary.read_dbf(spark, str(tmp_path / "a.dbf")), ["geoid", "name", "none"]).orderBy("seq").collect()
    assert [(r.geoid, r.name, r.none) for r in got] == [("01001", "Año", None), ("01003", None, None)]
    square = [(-96.0, 37.0), (-96.0, 37.1), (-95.9, 37.1), (-95.9, 37.0), (-96.0, 37.0)]
    hole = [(-95.975, 37.025), (-95.925, 37.025), (-95.925, 37.075), (-95.975, 37.075), (-95.975, 37.025)]
    (tmp_path / "a.shp").write_bytes(shp([[square], [square, hole]]))
    v = binary.read_shp(spark, str(tmp_path / "a.shp")).withColumn("key", F.col("shape"))
    a = {r.key: r for r in S.areas(v, "key").collect()}
    want = 0.1 * math.pi / 180 * 6378.137**2 * (1 - 0.00669438) / (1 - 0.00669438 * math.sin(math.radians(37.05)) ** 2) ** 2 * (math.radians(0.1) * math.cos(math.radians(37.05)))
    assert a[0].area_sqkm == pytest.approx(want, rel=1e-4) and a[1].area_sqkm == pytest.approx(a[0].area_sqkm * 0.75, rel=1e-3)
    assert a[0].x == pytest.approx(a[1].x, abs=5) and abs(a[0].x - 4400) < 200


def test_rasters(spark):
    grid = np.zeros((3, 70))
    grid[1, 2], grid[2, 40], grid[1, 69] = 0.5, 1.0, float("nan")
    df = spark.createDataFrame([("a", 70, [float(v) for v in grid.ravel()])], "k string, width int, values array<double>")
    px = S.pixels_of(df, ["k"])
    t = S.county_tensors(px, ["k"]).first()
    assert (t.height, t.width, t.valid_pixels) == (3, 70, 209)
    got = {(r.tile_row, r.tile_col): r for r in S.tiles(px.where("NOT isnan(value)"), ["k"]).collect()}
    assert set(got) == {(0, 0), (0, 1)} and len(got[0, 0].tile) == 1024 and got[0, 0].tile[1 * 32 + 2] == 0.5 and got[0, 1].tile_index == 1
    c = S.clip_normalised(spark.createDataFrame([("a", float(i)) for i in range(101)], "k string, value double"), ["k"])
    v = sorted(r.value for r in c.collect())
    assert v[0] == 0 and v[-1] == 1 and v[50] == pytest.approx(0.5)
    blob = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<float>").select(S.packed("v").alias("b")).select(S.unpacked("b").alias("v")).collect()
    assert blob[0].v == [1.0, 2.5] and blob[1].v is None
    assert np.allclose(S.bilinear(np.arange(4.0).reshape(2, 2), 2, 2), [[0, 1], [2, 3]]) and S.nearest(np.arange(4).reshape(2, 2), 4, 4)[3, 3] == 3
    years = spark.createDataFrame([("60010", 2020), ("60010", 2021), ("01001", 2020)], "fips string, year int")
    assert S.without_legacy(years).count() == 2


def test_streams(spark, tmp_path):
    from panelweave.streaming import live

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 2020, 0.0, 100.0), ("a", 2021, 5.0, 0.0), ("b", 2020, 0.0, 7.0)], "fips string, year int, flow double, start double").write.parquet(src)
    stream = spark.readStream.schema("fips string, year int, flow double, start double").parquet(src)
    q = live.append_stream(stream, str(tmp_path / "out"), ["fips", "year"], str(tmp_path / "c1"))
    q.awaitTermination(120)
    q = live.append_stream(stream, str(tmp_path / "out"), ["fips", "year"], str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = live.carried_levels(stream).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.fips, r.year): r.level for r in spark.table("levels").collect()} == {("a", 2020): 100.0, ("a", 2021): 105.0, ("b", 2020): 7.0}
    ev = str(tmp_path / "ev")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(ev)
    q = live.daily_totals(spark.readStream.schema(e.schema).parquet(ev)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r.day), r.event_type, r.n) for r in spark.table("days").collect()) == sorted((str(r.day), r.event_type, r.n) for r in live.daily_totals(e).collect())
