"""XLSX sheets, DBF tables and SHP polygons, read from binaryFile scans by Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import to_double

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(cell: str) -> int:
    """'A1' -> 0, 'AB7' -> 27."""
    n = 0
    for c in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet, shared and inline strings resolved."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        for r, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{MAIN}row")):
            for at, c in enumerate(row.iter(f"{MAIN}c")):
                v, kind = c.find(f"{MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                yield int(row.get("r") or r + 1) - 1, column_number(c.get("r")) if c.get("r") else at, text


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, text) of the first sheet of each workbook."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(f, *c) for f, data in zip(p["path"], p["content"], strict=True) for c in sheet_cells(data)], columns=["path", "row", "col", "text"])

    return _binary(spark, path).mapInPandas(run, "path string, row int, col int, text string")


def area_series(cells: DataFrame, most_header: int = 80) -> DataFrame:
    """(path, area, year, value): years stand in the row under 'Geographic Area', areas begin with a point, notes end the table."""
    first = F.lower(F.trim("text"))
    head = cells.where((F.col("row") < most_header) & first.startswith("geographic area")).groupBy("path").agg(F.min(F.struct("row", "col")).alias("h")).select("path", F.col("h.row").alias("head"), F.col("h.col").alias("at"))
    c = cells.join(F.broadcast(head), "path")  # one row per workbook
    years = c.where((F.col("row") == F.col("head") + 1) & F.col("text").rlike(r"^\s*\d{4}(\.0*)?\s*$")).select("path", "col", F.col("text").try_cast("double").cast("int").alias("year"))
    areas = c.where((F.col("col") == F.col("at")) & (F.col("row") > F.col("head") + 1)).select("path", "row", F.trim("text").alias("area"))
    end = areas.where(F.lower("area").rlike("^(source|note)s?:")).groupBy("path").agg(F.min("row").alias("end"))
    areas = areas.join(end, "path", "left").where((F.col("end").isNull() | (F.col("row") < F.col("end"))) & F.col("area").startswith("."))
    values = cells.select("path", "row", "col", to_double(F.regexp_replace("text", ",", "")).alias("value")).where("value IS NOT NULL")
    return values.join(areas, ["path", "row"]).join(years, ["path", "col"]).select("path", F.regexp_replace("area", r"^\.+", "").alias("area"), "year", "value")


def dbf_rows(data: bytes) -> tuple[list[str], Iterator[list[str | None]]]:
    """Field names and the records that are not deleted, as trimmed strings."""
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1").lower(), data[at + 16]))
        at += 32

    def rows() -> Iterator[list[str | None]]:
        for i in range(count):
            p = head + i * size
            if data[p : p + 1] == b"*":
                continue
            p, out = p + 1, []
            for _, n in fields:
                out.append(data[p : p + n].decode("latin-1").strip() or None)
                p += n
            yield out

    return [f for f, _ in fields], rows()


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, fields): every record as a map of lower-case names to strings."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for f, data in zip(p["path"], p["content"], strict=True):
                names, rows = dbf_rows(data)
                out += [(f, i, dict(zip(names, r, strict=True))) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "seq", "fields"])

    return _binary(spark, path).mapInPandas(run, "path string, seq int, fields map<string,string>")


def fields(records: DataFrame, names: list[str]) -> DataFrame:
    return records.select("path", "seq", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in names])


def shp_vertices(data: bytes) -> Iterator[tuple[int, int, int, float, float]]:
    """(shape, ring, vertex, x, y) of polygon records."""
    at, shape = 100, 0
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            n_parts, n = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            for ring in range(n_parts):
                for v in range(starts[ring], starts[ring + 1]):
                    yield shape, ring, v - starts[ring], xy[2 * v], xy[2 * v + 1]
        at, shape = at + 8 + size, shape + 1


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, ring, seq, lon, lat); shape n belongs to record n of the DBF beside it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for f, data in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame([(f, *v) for v in shp_vertices(data)], columns=["path", "shape", "ring", "seq", "lon", "lat"])

    return _binary(spark, path).mapInPandas(run, "path string, shape int, ring int, seq int, lon double, lat double")
