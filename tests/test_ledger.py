"""Atomic appends: retries, two writers, crashes, schemas, pruning."""

import pytest

from panelweave.sources.ledger import Ledger

SCHEMA = "k long, v string"


def rows(spark, *keys, v="x"):
    return spark.createDataFrame([(k, v) for k in keys], SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read(SCHEMA).collect()), key=str)


def test_retries_and_overlaps(spark, tmp_path):
    t = Ledger(spark, f"file://{tmp_path}/t", ["k"])
    assert held(t) == []
    assert t.append("a", rows(spark, 1, 2, 2, None)) and not t.append("a", rows(spark, 9))
    assert t.append("b", rows(spark, 2, 3, None, v="y")) and t.append("none", rows(spark))
    assert held(Ledger(spark, f"file://{tmp_path}/t", ["k"])) == sorted([(1, "x"), (2, "x"), (3, "y"), (None, "x")], key=str)
    with pytest.raises(ValueError, match="schema differs"):
        t.append("c", spark.createDataFrame([(1, 2)], "k long, v long"))


def test_two_writers(spark, tmp_path):
    """The other writer commits overlapping keys between this one's write and its commit, twice."""
    folder, others = f"file://{tmp_path}/t", [("other1", (2, 3)), ("other2", (3, 4))]

    class Slow(Ledger):
        def _before_commit(self):
            if others:
                batch, keys = others.pop(0)
                assert Ledger(spark, folder, ["k"]).append(batch, rows(spark, *keys, v=batch))

    assert Slow(spark, folder, ["k"]).append("mine", rows(spark, 1, 2, 3, 4, 5, v="mine"))
    assert held(Ledger(spark, folder, ["k"])) == [(1, "mine"), (2, "other1"), (3, "other1"), (4, "other2"), (5, "mine")]


def test_a_crash_before_the_commit(spark, tmp_path):
    folder = f"file://{tmp_path}/t"

    class Dies(Ledger):
        def _before_commit(self):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Dies(spark, folder, ["k"]).append("a", rows(spark, 1))
    t = Ledger(spark, folder, ["k"])
    assert held(t) == []
    (tmp_path / "t" / "log" / "000000000001").write_text('{"batch": "cut o')
    assert t.append("a", rows(spark, 1)) and t.append("b", rows(spark, 1, 2)) and held(t) == [(1, "x"), (2, "x")]


def test_other_buckets_are_not_read(spark, tmp_path):
    t = Ledger(spark, f"file://{tmp_path}/t", ["k"])
    t.append("a", rows(spark, *range(500)))
    few = t._bucketed(rows(spark, 7, 1000))
    buckets = [r[0] for r in few.select("_bucket").distinct().collect()]
    read = t._keys_in([e.part for e in t.entries()], buckets)
    assert len(buckets) <= 2 and len({f.split("_bucket=")[1].split("/")[0] for f in read.select("k", "_metadata.file_path").toPandas()["file_path"]}) <= 2
    assert "PartitionFilters: [isnotnull" in read._jdf.queryExecution().toString() or "PartitionFilters: [_bucket" in read._jdf.queryExecution().toString()
