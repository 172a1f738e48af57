import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galewright.llm.tokenize import PIECES, encode_corpus, encoder, vocabulary_path

regex = pytest.importorskip("regex")
pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary file")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "\n\n", "a", "Hello  world's 123 \t", "<|endoftext|> hi", "=" * 77, "a" * 3000, "ab" * 500, " " * 300 + "x", "Getriebeöl, élevée, señal", "é ​ 　 🌬️🇫🇷", "日本語のテキスト", "I'LL we'll", "\x00\x01", "١٢٣ ½ Ⅷ"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_equals_the_public_library(public, text):
    assert encoder(vocabulary_path()).encode(text, regex.compile(PIECES)) == public(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abn tion", max_size=80), st.text("=-_. ", max_size=60)))
def test_any_text_equals_tiktoken(text):
    import tiktoken

    e = encoder(vocabulary_path())
    reference = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=e.ids, special_tokens={})
    assert e.encode(text, regex.compile(PIECES)) == reference.encode_ordinary(text)


def test_ids_join_to_the_text():
    e = encoder(vocabulary_path())
    back = {i: b for b, i in e.ids.items()}
    text = "Zwischen 80 und 95 Grad; the rotor — stopped.\r\n" * 20
    assert b"".join(back[i] for i in e.encode(text, regex.compile(PIECES))).decode() == text


def test_frames(spark, public):
    df = spark.createDataFrame([(1, "wind speed", "x"), (1, "wind speed", "y"), (2, "", "x"), (3, None, "x"), (None, "a b", "x")], "doc_id long, text string, ids string")
    out = encode_corpus(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((str(r["doc_id"]), r["ids"]) for r in out.collect())
    assert got == sorted([("1", public("wind speed"))] * 2 + [("2", []), ("3", []), ("None", public("a b"))])
    assert encode_corpus(df.where("false")).collect() == []
