import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from annospark.llm import bpe

ODD = [
    None, "", " ", "a", "Hello, World's end!!  it'll <|endoftext|>x<|startoftext|>", "<|endoftext|>", "ÀÉÎ Straße ẞ İstanbul ΣΑΣ ς",
    "é café", "naïve 12345 ½ ² Ⅷ ٣", "日本語 テキスト 한국어", "a b c\u0085d\x1ce", "😀👍🏽 ok", "x" * 5000,
    "don't we're I've I'm he'd 'tis '", "<|endoftext", "​﻿­", "a" * 3 + "\n\t" + "…—", "İ", "ﬁ ﬂ Å Ω",
]


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    return bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)


def agree(both, text):
    mine, theirs = both
    want = theirs.encode(text or "", add_special_tokens=False).ids
    ids = mine.encoded(text)
    decoded = mine.decoded(ids)
    assert mine.ids(text) == want, text
    assert decoded == mine.decode(want) == theirs.decode(want, skip_special_tokens=False)
    assert ids == " ".join(map(str, want))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    agree(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF, categories=("L", "N", "P", "Zs", "S")), max_size=60))
def test_any_text(both, text):
    agree(both, text)


def test_segment_tree_is_leftmost_lowest():
    pairs = {1 << 20 | 1: 0 << 20 | 2, 2 << 20 | 2: 1 << 20 | 3, 2 << 20 | 1: 2 << 20 | 4}
    assert bpe.merge([1, 1, 1], pairs) == [4]
    assert bpe.merge([1, 1, 1, 1, 1], pairs) == [3, 1]


def test_tables(spark):
    docs = spark.createDataFrame(
        [(1, "Hello there", 5), (1, "Hello there", 5), (None, "x", 6), (3, None, 7), (4, "", 8)], "doc_id long, text string, n_tokens int")
    rows = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(docs).collect()}
    assert len(bpe.round_trip(docs).collect()) == 5
    assert rows[3, 0].ids_sha256 == rows[4, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(docs.filter("false")).collect() == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[1] == "hello</w> there</w>" and back[4] == ""


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_library(spark, both, size):
    from annospark.llm.common import read

    sf = f"/root/testdata/{size}"
    want = {}
    for r in read(spark, sf, "documents").collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe(spark, sf).collect()}
    assert got == want
