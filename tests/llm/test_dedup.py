import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from panelweave.llm import dedup

def check(df):
    groups = defaultdict(list)
    rows = df.select("doc_id", "text").collect()
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    best = {n: min(m, key=lambda x: (x[0], x[1], x[2] or 0)) for n, m in groups.items()}
    want = sorted(((i, best[n][2], len(m), (c, none, i) == best[n], hashlib.sha256(n.encode()).hexdigest()) for n, m in groups.items() for c, none, i in m), key=str)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.report(df).collect()), key=str)
    assert got == want


def test_real(real):
    check(real)


def test_odd(odd, none):
    check(odd)
    assert dedup.report(none).count() == 0
    assert set(odd.columns) <= set(dedup.with_classes(odd).columns)


def test_hot_group(spark, real):
    check(real.unionByName(spark.range(5000, 5200).selectExpr("id AS doc_id", "concat('a hot', repeat(' ', cast(id % 5 as int)), 'text') AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")))


def test_content_decides_not_the_digest(spark, monkeypatch):
    """With a digest that says nothing, different texts raise and are not merged."""
    import pytest

    monkeypatch.setattr(dedup.F, "sha2", lambda c, n: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="two texts"):
        dedup.classes(df).collect()


def test_null_ids_and_shared_ids(spark):
    """A null id stays only alone; the largest id is an id like others; of rows that share an id the longer text stays."""
    rows = [(None, "a b"), (9223372036854775807, "ab"), (None, "c"), (None, "c"), (9223372036854775807, "d"), (1, "e f"), (1, "ef"), (0, "ef"), (-(2**63), "g"), (2, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    left = sorted(map(tuple, dedup.kept_rows(df).collect()), key=str)
    assert left == sorted([(None, "a b"), (None, "c"), (9223372036854775807, "d"), (1, "e f"), (-(2**63), "g")], key=str)


def test_of_tied_rows_the_least_stays(spark):
    rows = [(1, "a b c", "x"), (1, "ab  c", "y"), (1, "a bc ", "z")]
    for order in (rows, rows[::-1]):
        assert [tuple(r) for r in dedup.kept_rows(spark.createDataFrame(order, "doc_id long, text string, lang string")).collect()] == [(1, "a b c", "x")]


def test_clashing_names(spark, odd):
    df = odd.selectExpr("*", "1 AS _digest", "2 AS _salt", "3 AS _norm", "4 AS _row", "5 AS _rank", "6 AS `a.b`")
    assert dedup.with_classes(df).count() == df.count()
    assert dedup.kept_rows(df).columns == df.columns


def test_copies_without_an_id_are_spread(spark):
    """20,000 equal rows, no ids: no group by digest and salt holds more than a few hundredths of them."""
    df = spark.createDataFrame([(None, "the same text")] * 20_000, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in dedup.report(df).collect()} == {(None, None, 20_000, True, dedup.report(df).first().text_sha256)}
    salts = dedup.salted(df, "text", dedup.F.pmod(dedup.F.xxhash64(dedup.F.monotonically_increasing_id()), dedup.F.lit(dedup.SALTS)), ["doc_id"]).groupBy("_salt").count().collect()
    assert len(salts) == dedup.SALTS and max(r["count"] for r in salts) < 1000


def test_columns_that_cannot_be_ordered(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "ab "), (2, "c")], "doc_id long, text string").selectExpr("*", "map('k', doc_id) AS m", "array(map(1, 2)) AS n")
    assert sorted((r.doc_id, r.text, r.m) for r in dedup.kept_rows(df).collect()) == [(1, "a b", {"k": 1}), (2, "c", {"k": 2})]
