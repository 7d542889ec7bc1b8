import re

import corpus_pipeline as C
from panelweave.llm.common import staged

from .test_ngram_join import brute


def test_stages_on_real_rows(spark, real):
    docs, before = real, None
    for name, stage in C.STAGES:
        before, docs = docs, staged(stage(spark, docs, ""), name)
        if name != "pack":
            assert docs.columns == C.COLUMNS
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()]
            assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in before.collect()})
        if name == "near_dedup":
            want = {d for d, (_, c) in brute(before.collect(), 5, 80).items() if c == d}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "mask_pii":
            assert docs.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in C.STAGES:
        for df in (odd, none):
            out = stage(spark, df, "")
            assert out.count() <= 10 * df.count() and (name == "pack" or out.columns == C.COLUMNS)


def test_repeated_rows_leave_one(spark, odd):
    assert C.exact_dedup(spark, odd, "").where("doc_id = 8").count() == 0  # 4 is the smallest of its class
    twice = spark.createDataFrame([(1, "same text", "en", "s", 9)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert C.exact_dedup(spark, twice, "").count() == 1


def test_run(spark):
    rows = C.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_a_shared_id_takes_no_other_text_along(spark):
    """Of two rows with id 8 one is a near copy of 3; the other one and rows without an id stay, but for a near copy among them."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    alone = " ".join(f"x{i}" for i in range(60))
    noid = " ".join(f"y{i}" for i in range(60))
    rows = [(3, " ".join(words)), (8, near), (8, alone), (None, noid), (None, noid + " end"), (9, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r.doc_id, r.text[:2]) for r in C.near_dedup(spark, docs, "").collect()), key=str)
    assert left == sorted([(3, "w0"), (8, "x0"), (9, "sh"), (None, "y0")], key=str)
