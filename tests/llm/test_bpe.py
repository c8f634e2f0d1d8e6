import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkwright.llm import bpe

FILE = bpe.default_file()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_as_the_library(spark, odd, library):
    for r in bpe.encode_decode(odd.withColumnRenamed("text", "words").withColumnRenamed("_text", "text"), text_col="words", contents=True).collect():
        pass
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(odd).collect()}
    want = set()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeths'.,!1 2Éß", max_size=80)))
def test_any_text(text):
    t = Tokenizer.from_file(FILE) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert bpe.model(FILE).encode_ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_words_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    small = bpe.Bpe(FILE)
    texts = ["abracadabra " * 5, "zyx" * 400, "one two three four five six seven eight nine ten", "ten nine"] * 2
    for text in texts:
        assert small.encode_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty(make):
    assert bpe.encode_decode(make([])).collect() == []


def test_merges_of_many_words_are_those_of_each():
    model = bpe.Bpe(FILE)
    words = ["lowest", "", "a", "zzzzzz", "Ġ", "th" * 30, "xq", "ÃŃÃŃ", "日", "thequickbrown"]
    assert model.merged_many(words) == [np.array(model.merged(model.symbols(w)), "<u4").tobytes() for w in words]
    assert model.merged_many([]) == []


def test_the_cache_holds_a_pieces_ids_alone():
    """Ids and decoded text of each piece, twice, took an executor beyond its memory."""
    model = bpe.Bpe(FILE)
    ((cut, table),) = model.encode(["Theragon, <|endoftext|>theragon élan x-y"])
    assert all(type(table[p]) is bytes for p in cut)
    ids = b"".join(table[p] for p in cut)
    assert model.decoded(ids).decode() == model.decode(np.frombuffer(ids, "<u4"))
