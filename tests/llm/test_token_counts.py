import pytest
from pyspark.sql import functions as F

from panelweave.llm.common import new_folder
from panelweave.llm.token_counts import Rollup, changes, report


def rows(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_batches(spark):
    book = Rollup(spark, new_folder(spark, "book"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d e", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    assert rows(book.totals()) == {}
    assert book.commit("one", changes(docs, "words_v1", 1))
    first = {("s", "en", "words_v1"): (2, 5), (None, None, "words_v1"): (1, 0)}
    assert rows(book.totals()) == first
    assert not book.commit("one", changes(docs, "words_v1", 1)) and rows(book.totals()) == first
    two = docs.where("doc_id = 2")
    assert book.commit("revise", changes(two, "words_v1", -1).unionByName(changes(two, "words_v1", 1, F.lit(9))))
    assert rows(book.totals())["s", "en", "words_v1"] == (2, 12)
    assert book.commit("delete", changes(docs.where("doc_id <> 2"), "words_v1", -1)) and rows(book.totals()) == {("s", "en", "words_v1"): (1, 9)}
    assert book.commit("nothing", changes(docs.limit(0), "words_v1", 1)) and rows(book.totals()) == {("s", "en", "words_v1"): (1, 9)}
    with pytest.raises(ValueError):
        book.commit("../x", changes(docs, "words_v1", 1))


def test_a_lost_draft_does_not_count(spark):
    book = Rollup(spark, new_folder(spark, "book"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    changes(docs, "words_v1", 1).write.parquet(f"{book.folder}/_draft-lost")
    assert rows(book.totals()) == {} and book.committed() == set()


def test_an_unmarked_folder_does_not_count(spark, monkeypatch):
    """A driver lost between writing and marking leaves totals as they were; the repeat applies the batch."""
    book = Rollup(spark, new_folder(spark, "book"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    with monkeypatch.context() as m:
        m.setattr(Rollup, "_mark", lambda self, folder: None)
        book.commit("one", changes(docs, "words_v1", 1))
    assert rows(book.totals()) == {} and book.committed() == set()
    assert book.commit("one", changes(docs, "words_v1", 1)) and rows(book.totals()) == {("s", "en", "words_v1"): (1, 3)}


def test_two_committers_of_one_batch(spark, monkeypatch):
    """Neither sees the other; the batch counts once."""
    folder = new_folder(spark, "book")
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    with monkeypatch.context() as m:
        m.setattr(Rollup, "committed", lambda self: set())
        for _ in range(2):
            assert Rollup(spark, folder).commit("one", changes(docs, "words_v1", 1))
    assert rows(Rollup(spark, folder).totals()) == {("s", "en", "words_v1"): (1, 3)}


def test_compaction(spark):
    book = Rollup(spark, new_folder(spark, "book"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d", None, "s")], "doc_id long, text string, lang string, source string")
    book.compact()
    for i in range(3):
        assert book.commit(f"b{i}", changes(docs, "words_v1", 1))
        book.compact()
        before = rows(book.totals())
        assert not book.commit(f"b{i}", changes(docs, "words_v1", 1)) and rows(book.totals()) == before
    assert before == {("s", "en", "words_v1"): (3, 9), ("s", None, "words_v1"): (3, 3)}
    assert len(book.deltas().inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("when", ["before the sums", "after the sums"])
def test_a_commit_during_compaction_counts_once(spark, when):
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    folder = new_folder(spark, "book")
    Rollup(spark, folder).commit("first", changes(docs, "words_v1", 1))

    class Slow(Rollup):
        def _sums(self, *paths):
            made = None if when == "before the sums" else super()._sums(*paths)
            assert Rollup(spark, folder).commit("late", changes(docs, "words_v1", 1))
            return made or super()._sums(*paths)

    Slow(spark, folder).compact()
    book = Rollup(spark, folder)
    assert rows(book.totals()) == {("s", "en", "words_v1"): (2, 6)} and book.committed() == {"first", "late"}
    assert not book.commit("late", changes(docs, "words_v1", 1))
    book.compact()
    assert rows(book.totals()) == {("s", "en", "words_v1"): (2, 6)}


def plain(df):
    """Totals of the first row of each text, by smallest id, null last."""
    import re

    out, seen = {}, set()
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.source is not None, r.source or "", r.lang is not None, r.lang or "")):
        if (t := r.text or "") not in seen:
            seen.add(t)
            n = len(re.findall(r"[^\W_]+|[^\w\x20\x09-\x0D]|_", t))
            key = (r.source, r.lang, "words_v2")
            out[key] = tuple(map(sum, zip(out.get(key, (0, 0)), (1, n), strict=True)))
    return out


def test_odd_tables(spark, odd, none, tmp_path):
    twice = odd.unionByName(odd).unionByName(odd.selectExpr("doc_id", "text", "lang", "'zz' AS source", "n_chars", "n_words", "kept", "size", "piece", "keep_id", "n", "score", "digest", "shard"))
    for name, df in (("odd", odd), ("twice", twice), ("none", none)):
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert rows(report(spark, f"file://{tmp_path}/{name}")) == plain(df)


def test_repeats_and_null_ids(spark, tmp_path):
    table = [(1, "x y", "en", "s"), (1, "x y", "en", "s"), (None, "q r", "en", "s"), (None, "q r", "en", "s"), (5, "q r", "en", "t"), (7, "x y", None, None)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(report(spark, f"file://{tmp_path}")) == {("s", "en", "words_v2"): (1, 2), ("t", "en", "words_v2"): (1, 2)}
