import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from panelweave.llm import sharding


def smallest(sizes, shards):
    def fits(c):
        n, used = 1, 0
        for z in sizes:
            if z > c:
                return False
            if used + z > c:
                n, used = n + 1, 0
            used += z
        return n <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def totals(df):
    out = Counter()
    for r in df.collect():
        t = (r.text or "").encode()
        out[hashlib.sha256(t).hexdigest()] += len(t) + 8
    return out


@pytest.mark.parametrize("shards", [1, 3, 24, 100])
@pytest.mark.parametrize("first", [1, 4])
def test_minimax(real, monkeypatch, shards, first):
    monkeypatch.setattr(sharding, "FIRST", first)
    monkeypatch.setattr(sharding, "STEP", 1)
    from pyspark.sql import functions as F

    groups = real.select(*sharding.sized(real)).groupBy("_digest").agg(F.sum("size").alias("total"))
    t = totals(real)
    assert sharding.partition(groups, shards)[0] == smallest([t[k] for k in sorted(t)], shards)


def test_even_cuts_keep_the_capacity():
    rng = random.Random(1)
    for _ in range(200):
        blocks = [(f"{i:04x}", rng.choice([1, 5, 50, 400]), 1) for i in range(rng.randint(1, 60))]
        o = sharding.Order(blocks, rng.randint(1, 12))
        c = o.smallest(o.sure)
        assert c == smallest([b[1] for b in o.blocks], o.shards)
        cuts, load = o.even_cuts(c), defaultdict(int)
        for p, size, _ in o.blocks:
            load[sum(p >= x for x in cuts)] += size
        assert max(load.values()) <= c and max(load) < o.shards


def check(df):
    rows = sharding.assign(df).collect()
    assert len(rows) == df.count()
    by, group = defaultdict(list), {}
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        by[r.shard].append(r.slot)
        assert any((r["size"], r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts[r.doc_id])
        assert group.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    t = totals(df)
    assert max(load.values()) <= smallest([t[k] for k in sorted(t)], 24) if t else not rows


def test_real(real):
    check(real)


def test_odd(odd, none):
    check(odd)
    assert sharding.assign(none).count() == 0


def test_hot_group(spark, real):
    check(real.unionByName(spark.range(5000, 5150).selectExpr("id AS doc_id", "'the same text again and again' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")))
