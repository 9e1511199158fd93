import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenrel.llm import bitplane

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.booleans(), st.integers(1, 17))
def test_file_round_trip(docs, bits, block):
    out = io.BytesIO()
    w = bitplane.Writer(out, block=block, bits=bits)
    for i, ids in enumerate(docs):
        w.add(i, np.array(ids, "<u4").tobytes())
    size = w.close()
    assert size == len(out.getvalue())
    r = bitplane.Reader(out, size)
    got = list(r.documents())
    assert [np.frombuffer(x, "<u4").tolist() for _, _, x in got] == docs
    flat = [x for d in docs for x in d]
    assert r.total == len(flat)
    for a in range(0, len(flat), 5):
        z = min(len(flat), a + 23)
        assert r.ids(a, z).tolist() == flat[a:z]


WORDS = ["", " ", "Hello, World!", "don't THE'S ''s 'll", "a\x1cb\x1fc", "x\x85y\xa0z", "İstanbul ΣΑΣ straße ﬁne", "é é ́a", "12 3.4 a1b2", "<|endoftext|> <|ENDOFTEXT|>", "!!a!! ***b*** ,.,", "日本語 text", "tab\tnew\nline\r\n", "_a_b_", "a" * 5000, "\x00\x01 a"]


def test_encoder_equals_library():
    lib = Tokenizer.from_file(PATH)
    enc = bitplane.WordEncoder(PATH)
    for _ in range(2):
        got = enc.encode(WORDS)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in WORDS]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=30))
def test_encoder_equals_library_on_any_text(text):
    enc = bitplane.encoder(PATH)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abZ éß×÷«.,!?'s12-\n\t\x85\xa0ŁƎ", max_size=20), max_size=5))
def test_encoder_cuts_where_the_library_cuts(texts):
    enc = bitplane.encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_with_a_full_table_and_texts_in_parts():
    words = [f"{a}{b}{c}" for a in "straße zu über".split() for b in "abcdefghij" for c in "klmnopqrst"]
    texts = [" ".join(words[i : i + 60]) + ", end." for i in range(0, len(words), 40)] + [" ".join(words * 3), "x" * 5000 + " y", ""]
    enc = bitplane.WordEncoder(PATH, most=150)
    want = [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts, at_once=500)] == want


@pytest.mark.parametrize("bits", [False, True])
def test_documents_round_trip(spark, bits):
    rows = [(5, "b c", 1), (2, None, 2), (9, "", 3), (2, "a twin of 2", 4), (None, "no id", 5), (7, "long " * 30_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3)
    out = bitplane.read_documents(bitplane.encode_documents(docs, PATH, bits=bits, block=1000), with_ids=True).collect()
    lib = Tokenizer.from_file(PATH)
    assert len(out) == len(rows)
    out.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, 2, 2, 5, 7, 9]
    want = sorted(str(lib.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows)
    assert sorted(str(np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want
    at = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bitplane.read_documents(bitplane.encode_documents(docs, PATH)).collect() == []
