"""Encoding against the library that owns the vocabulary, appends, edits, nulls and long texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.common import table, vocab_path
from paperloom.llm.tokenize import Document, PrefixTable, encode_corpus, encoder

VOCAB = vocab_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert encoder(VOCAB).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_and_special(library):
    for text in ("a" * 5000, " " * 400 + "x", "<|endoftext|>", "ы" * 700, "\n\n\t  9" * 50):
        assert encoder(VOCAB).encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=30), st.integers(0, 30), st.integers(0, 30), st.binary(max_size=8))
def test_appends_and_edits_equal_a_new_table(a, b, i, j, c):
    vocab = encoder(VOCAB).cache.vocab
    whole = PrefixTable(vocab, a + b)
    assert PrefixTable(vocab, a).append(b).tokens() == whole.tokens() == vocab.merge(a + b)
    i, j = sorted((min(i, len(a + b)), min(j, len(a + b))))
    raw = (a + b)[:i] + c + (a + b)[j:]
    assert whole.edit(i, j, c).tokens() == vocab.merge(raw)


def test_an_edit_costs_no_tail():
    vocab = encoder(VOCAB).cache.vocab
    rng = random.Random(4)
    raw = bytes(rng.choice(b"etaoinshrdlu") for _ in range(20_000))
    for begin, end, new in ((3, 4, b"z"), (9000, 9000, b"qq"), (12_000, 12_007, b""), (0, 1, b""), (0, 0, b"x")):
        whole = PrefixTable(vocab, raw)
        before = whole.filled
        whole.edit(begin, end, new)
        assert whole.filled - before < 300
        assert whole.last == PrefixTable(vocab, raw[:begin] + new + raw[end:]).last and whole.raw == raw[:begin] + new + raw[end:]


@settings(max_examples=150, deadline=None)
@given(st.text("ab 1'.s\n", max_size=40), st.integers(0, 40), st.integers(0, 40), st.text("ab 1'.s\n", max_size=6), st.text("ab 1'.s\n", max_size=6))
def test_documents_edited_and_appended(text, i, j, new, more):
    enc = encoder(VOCAB)
    i, j = sorted((min(i, len(text)), min(j, len(text))))
    doc = Document(enc, text).edit(i, j, new)
    assert doc.tokens() == enc.encode(text[:i] + new + text[j:])
    assert doc.append(more).tokens() == enc.encode(text[:i] + new + text[j:] + more)


def test_an_edit_of_a_document_is_local():
    doc = Document(encoder(VOCAB), "the frame waits for the timer. " * 2000)
    before = doc.encoded
    doc.edit(300, 301, "X")
    doc.append(" end")
    assert doc.encoded - before < 20 and Document(encoder(VOCAB), None).tokens() == []


def test_corpus(spark, sf, library):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r.ids for r in encode_corpus(docs, VOCAB).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: library.encode(v or "", add_special_tokens=False).ids for k, v in texts.items()}


def test_nulls_copies_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x", "c"), (2, "hi hi", "d"), (2, "hi hi", "d")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, VOCAB).collect()), key=repr)
    assert got == [(1, []), (1, []), (2, [5303, 23105]), (2, [5303, 23105]), (None, [87])]
    assert encode_corpus(df.filter(F.lit(False)), VOCAB).count() == 0
