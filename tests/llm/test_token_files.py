import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelweave.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = T.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (T.unpack(data, bits, n) == ids).all()
        assert (T.unpack(data, bits, n // 2, n // 3) == ids[n // 3 : n // 3 + n // 2]).all()


def test_least_width():
    assert [T.width(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize(("bits", "block"), [(16, 64), (17, 64), (13, 7), (17, 3)])
def test_random_access(tmp_path, bits, block):
    rng = random.Random(block)
    docs = [(i if i % 9 else None, np.array([rng.randrange(1 << bits) for _ in range(rng.choice([0, 1, 5, 70, 400]))], "<u4")) for i in range(60)] + [(99, np.zeros(0, "<u4"))]
    uri = f"file://{tmp_path}/x.ids"
    out = T.Writer(uri, bits, block)
    for i, ids in docs:
        out.put(i, ids.tobytes())
    out.close()
    one, every = T.Reader(uri), np.concatenate([d for _, d in docs])
    assert len(one) == len(docs) and one.checks() == [zlib.crc32(d.tobytes()) for _, d in docs]
    for k in rng.sample(range(len(docs)), 30):
        assert (one.document(k) == docs[k][1]).all()
        assert (None if one.nulls[k] else int(one.ids[k])) == docs[k][0]
    for _ in range(200):
        a = rng.randrange(len(every))
        b = rng.randint(a, len(every))
        assert (one.range(a, b) == every[a:b]).all()
    assert sum(len(d) for _, d in docs) * bits / 8 <= one.offsets[-1] - one.offsets[0] <= sum(len(d) for _, d in docs) * bits / 8 + len(one.offsets)
    with pytest.raises(ValueError):
        (tmp_path / "cut.ids").write_bytes((tmp_path / "x.ids").read_bytes()[:-5])
        T.Reader(f"file://{tmp_path}/cut.ids")


def check(df):
    plain = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = sorted(((i is not None, i or 0, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for (i, _), e in zip(rows, plain.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)))
    got = sorted(T.report(df, PATH).collect(), key=lambda r: (r.start, r.n_tokens))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)


def test_real(real):
    check(real)


def test_odd(odd, none):
    check(odd)
    check(none)


def test_hot_id_and_small_files(spark, monkeypatch):
    """A third of the rows share an id, another third id and text; files end early; all stays in order and whole."""
    rows = [(7, f"word {i}") for i in range(300)] + [(8, "same text")] * 300 + [(None, None)] * 100 + [(i, "a b c " * (i % 50)) for i in range(1000, 1300)]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(T, "MOST_DOCUMENTS", 50)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_only_files_of_the_manifest_count(real, spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    files = T.write(real, PATH, folder)
    (tmp_path / "ids" / "part-00000-00000-stray.ids").write_bytes(b"half a file")
    assert T.read(T.manifest(spark, folder)).count() == T.read(files).count() == real.count()
