import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SIGNS = "ab  \n\t'sdlltreé中文字😀1२\x1c\x85\xa0 |##--AÜß́‍"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    return lambda t: np.array(plain.encode_ordinary(t), "<u4").tobytes()


def texts(n, seed=0, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_like_the_library(codec, library):
    for t in [*texts(4000), "a" * 3000, "=-" * 2000, " " * 3000, "ha" * 3000, "\n \n" * 1000, "<|endoftext|>"]:
        assert codec.encode(t) == library(t), repr(t[:40])


def test_words_of_letters(codec, library):
    rng = random.Random(7)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCéßñøƵɏɐªº¹'.,;!?ʼ1_") for _ in range(rng.randint(1, 12))) + rng.choice([".", ",", "", "!", "?:", "'s", "'s."])
        assert codec.encode(f"x {word} y") == library(f"x {word} y"), word


def test_many_words_stay_known(codec):
    """A corpus of half a million words is encoded once a word, not once an occurrence."""
    made = []
    kept = bpe._Kept(lambda w: made.append(w) or b"")
    for _ in range(2):
        for i in range(480_000):
            kept[f"w{i}"]
    assert len(made) == 480_000


def test_round_trip(codec):
    for t in texts(2000, 1):
        assert codec.decode(codec.encode(t)) == t.encode()


def test_table_like_merging(codec):
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdething") for _ in range(rng.randint(1, 40)))
        assert codec.read(codec.extend(data, [])) == codec.by_merging(data)


def test_append_keeps_entries(codec):
    a, b = b"internationalis", b"ationing of things"
    table = codec.extend(a, [])
    assert codec.extend(a + b, list(table)) == codec.extend(a + b, []) and codec.extend(a + b, [])[: len(a)] == table


def test_edit_is_local(codec):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abcdething") for _ in range(4000))
    table = codec.extend(data, [])
    changed, new, computed = codec.edit(data, table, 1000, 1004, b"xyz12")
    assert changed == data[:1000] + b"xyz12" + data[1004:] and new == codec.extend(changed, []) and computed < 500


def test_drafts(codec):
    rng = random.Random(4)
    for t in texts(300, 5, 40):
        d = bpe.Draft(codec, t)
        for _ in range(4):
            a = rng.randint(0, len(d.text))
            d.replace(a, rng.randint(a, min(len(d.text), a + 6)), "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 5))))
            assert d.encoded() == codec.encode(d.text)
        d.append(" don't")
        assert d.encoded() == codec.encode(d.text)


def test_query_rows(real, odd, none, library):
    for df in (real, odd):
        rows = sorted(bpe.report(df, PATH, public_tokenizers.PATTERN).collect(), key=str)
        want = sorted(((r.doc_id, len(i := library(r.text or "")) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()), key=str)
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.report(none, PATH, public_tokenizers.PATTERN).count() == 0
    ids = {r.doc_id: r for r in bpe.encoded(odd, PATH, public_tokenizers.PATTERN).collect()}
    assert bytes(ids[4].ids) == library("one two three") and bytes(ids[4].decoded) == b"one two three"
