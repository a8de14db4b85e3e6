import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import encoding
from codelode.llm.perfect_hash import PerfectHash

FULL = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FULL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FULL)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(h.numbers(keys).tolist()) == list(range(5000))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(st.sampled_from("ab é'sT1​\n\t\r\x1c\x85\xa0中Ⅷ½<|endoftext|>"), max_size=80)))
def test_equals_the_public_library(reference, text):
    assert encoding.encoder(encoding.VOCABULARY).encode(text) == reference(text)


def test_special_text_and_long_runs(reference):
    e = encoding.encoder(encoding.VOCABULARY)
    for text in ["<|endoftext|>", "a<|endoftext|>b", "x" * 5000, "ab" * 20000, " " * 3000 + "y", "\r\n" * 50, "\x00\x07"]:
        assert e.encode(text) == reference(text)
    assert e.encode(None) == e.encode("") == []


def test_every_entry_is_its_own_token(reference):
    e = encoding.encoder(encoding.VOCABULARY)
    for token in e._rank:
        text = token.decode("utf-8", "ignore")
        if text.encode() == token and len(e.pre_tokens(text)) == 1:
            assert e.merge(token) == (e._rank[token],)


def test_frame(spark, reference):
    texts = [None, "", "hello world", "hello world", "naïve ﬁ 日本 👨‍💻", "y" * 200_000]
    df = spark.createDataFrame([(i if i != 2 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = encoding.encode_corpus(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 2, list(r.ids)) for r in found) == [(i, reference(t) if t else []) for i, t in enumerate(texts)]
    assert encoding.encode_corpus(df.limit(0)).collect() == []


def test_documents_round_trip(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    found = {r.doc_id: list(r.ids) for r in encoding.encode_corpus(df).collect()}
    assert found == {k: reference(t) if t else [] for k, t in texts.items()}
