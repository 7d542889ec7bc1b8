import datetime
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from panelweave.llm import cobucket as C

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(row):
    return [(v is not None, v.encode() if isinstance(v, str) else v) for v in row]


def brute(sales, lines, buckets):
    """Rows of every final file and what is asked for of them, from whole tables in memory."""
    crc = lambda text: zlib.crc32(text.encode()) % buckets
    own = lambda i: buckets + 1 if i is None else crc(f"s{i}")
    counts = Counter(r[0] for r in sales if r[0] is not None)
    placed = {"sales": [], "sale_lines": []}
    for r in sales:
        b = own(r[0])
        placed["sales"].append((b - (b % 4 == 1), b, r, 0))
    for r in lines:
        b = buckets if r[0] is not None and r[0] not in counts else own(r[0])
        placed["sale_lines"].append((0 if r[2] is None else crc(str(r[2])), b, r, counts[r[0]] if r[0] is not None else 0))
    joined = Counter()
    for _, b, _, n in placed["sale_lines"]:
        joined[b] += n
    out = {}
    for table, rows in placed.items():
        by, starts = defaultdict(list), defaultdict(Counter)
        for s, b, r, _ in rows:
            by[b].append((s, r))
            starts[s][b] += 1
        for b, got in by.items():
            own_starts = Counter(s for s, _ in got)
            ordered = sorted((r for _, r in got), key=order)
            first = next(iter(own_starts))
            out[table, b] = (
                sha(",".join("" if r[0] is None else str(r[0]) for r in ordered)), sha(",".join(f"{s}:{own_starts[s]}" for s in sorted(own_starts))),
                len(got), joined[b], not (len(own_starts) == 1 and len(starts[first]) == 1), ordered,
            )
    return out


def check(sales, lines, folder, buckets):
    want = brute([tuple(r) for r in sales.collect()], [tuple(r) for r in lines.collect()], buckets)
    got = C.report(sales, lines, f"file://{folder}", buckets).collect()
    assert {(r.table_name, r.bucket) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        ids, lineage, n, joined, rewritten, rows = want[r.table_name, r.bucket]
        assert (r.ids_sha256, r.lineage_sha256, r.n_rows, r.n_joined, r.rewritten) == (ids, lineage, n, joined, rewritten), (r.table_name, r.bucket)
        file = pq.read_table(r.path.removeprefix("file://"))
        assert r.columns == ",".join(file.column_names) == ",".join((sales if r.table_name == "sales" else lines).columns)
        assert [tuple(x.values()) for x in file.to_pylist()] == rows
    left = {str(p) for p in Path(folder).rglob("*") if p.is_file()}
    assert left == {r.path.removeprefix("file://") for r in got}
    return got


@pytest.fixture(scope="module")
def shop(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    return read("sales"), read("sale_lines")


@pytest.mark.parametrize("buckets", [600, 7])
def test_real(shop, tmp_path, buckets):
    check(*shop, tmp_path / "t", buckets)


def test_starting_files_that_are_right_stay(shop, tmp_path):
    got = check(*shop, tmp_path / "t", 600)
    assert {r.rewritten for r in got if r.table_name == "sales"} == {True, False}


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated ids and rows, ties, negative and large ids, odd strings, a hot id and a hot item."""
    rng, day = random.Random(3), datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    ids = [None, None, 0, 1, 1, 1, -5, 2**62, *range(10, 60), 33]
    sales = [(i, rng.choice([None, 1, 2]), rng.choice([None, "", "é", "z", "😀", "￮"]), rng.choice([None, 1.5, -2.0]), rng.choice([None, day]), day, rng.choice([None, 1])) for i in ids]
    lines = [(rng.choice([None, 1, 1, 1, 7, 8, -5, 2**62, 40, 41, 999, -(2**40)]), rng.choice([None, 1, 2]), rng.choice([None, 3, 3, 3, 4, 5]), None, 1, rng.choice([None, 0.5]), None, rng.choice([None, "a" * 5000, "b"]), day) for _ in range(400)]
    lines += lines[:50]
    check(spark.createDataFrame(sales, SALES).repartition(3), spark.createDataFrame(lines, LINES).repartition(5), tmp_path / "t", 13)


def test_whole_files_stay_whatever_their_number(spark, tmp_path):
    """One bucket's rows alone in a file numbered for another: it stays, in both tables."""
    sales = [(i, 1, "x", 1.0, None, None, 1) for i in (5,)]
    lines = [(5, k, 77, 1, 1, 1.0, 0.0, "f", None) for k in range(4)] + [(6, 1, 78, 1, 1, 1.0, 0.0, "f", None)]
    got = check(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), tmp_path / "t", 600)
    assert not any(r.rewritten for r in got) and len(got) == 3


def test_empty_tables(spark, shop, tmp_path):
    none = spark.createDataFrame([], SALES), spark.createDataFrame([], LINES)
    assert check(*none, tmp_path / "a", 600) == []
    check(none[0], shop[1], tmp_path / "b", 5)
    check(shop[0], none[1], tmp_path / "c", 5)


def test_extra_columns_whose_names_clash(spark, tmp_path):
    sales = spark.createDataFrame([(i, 1, "x", 1.0, None, None, 1) for i in range(40)], SALES).selectExpr("*", "1 AS _number", "2 AS _start", "3 AS bucket", "4 AS n", "5 AS id", "6 AS start")
    lines = spark.createDataFrame([(i % 50, i, i % 3, 1, 1, 1.0, 0.0, "f", None) for i in range(200)], LINES).selectExpr("*", "1 AS _number", "2 AS _start", "3 AS bucket", "4 AS n", "5 AS id", "6 AS start")
    check(sales, lines, tmp_path / "t", 6)


def test_index_blocks(spark, tmp_path, monkeypatch):
    """Buckets of many blocks, read again after they have been let go."""
    monkeypatch.setattr(C, "INDEX_BLOCK", 8)
    monkeypatch.setattr(C, "KEPT_BLOCKS", 2)
    rng = random.Random(5)
    ids = [rng.randrange(-1000, 1000) for _ in range(900)]
    folder = C.build_index(spark.createDataFrame([(i,) for i in ids] + [(None,)], "k long"), "k", f"file://{tmp_path}/index", 3)
    index, counts = C.Index(folder), Counter(ids)
    for _ in range(30):
        some = [rng.randrange(-1200, 1200) for _ in range(100)]
        b = rng.randrange(3)
        mine = [i for i in some if zlib.crc32(f"s{i}".encode()) % 3 == b]
        assert index.counts(b, np.array(mine, np.int64)).tolist() == [counts[i] for i in mine]
    assert index.counts(9, np.array([1])).tolist() == [0]
