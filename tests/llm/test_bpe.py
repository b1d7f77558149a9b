"""Byte-level BPE against the tokenizers library, round trips and odd tables."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigmaflow.llm import bpe
from sigmaflow.llm.queries import QUERIES
from tests.conftest import SF_MID
from tests.llm.conftest import LONG

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        source = file.read()
    return bpe.Bpe(source), Tokenizer.from_str(source)


def ids(made: bytes) -> list[int]:
    return np.frombuffer(made, "<u4").tolist()


def same(both, text):
    mine, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    made = mine.encode(text)
    assert ids(made) == want
    assert mine.decode(made) == theirs.decode(want, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "\n\n  a", "I'll we've 'S it'd", "a" * 20_000, " " * 3000, "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y<|endoftext", "漢字 \x85\xa0 é", "1٣½²", "՘࢏ \U00010940a", "\x1c\x1d a"])
def test_texts(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    same(both, text)


def test_decoding_any_ids(both):
    mine, theirs = both
    rng = random.Random(5)
    for _ in range(200):
        some = [rng.randrange(50257) for _ in range(rng.randrange(30))]  # broken UTF-8 too
        assert mine.decode(np.array(some, "<u4").tobytes()) == theirs.decode(some, skip_special_tokens=False)
    assert mine.decode(np.array([60_000, 0], "<u4").tobytes()) == theirs.decode([0])


def test_kept_words_do_not_change_results(both, monkeypatch):
    mine, _ = both
    text = LONG[:20_000]
    want = mine.encode(text)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    fresh = bpe.Words(mine)
    assert b"".join(map(fresh.__getitem__, bpe._WORDS.findall(text))) == want and len(fresh) <= 10


def test_other_models_are_refused():
    with open(PATH, encoding="utf-8") as file:
        model = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"model": model["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.Bpe(json.dumps(model | change))


def test_odd_tables(spark, odd_docs, no_docs, both):
    clash = odd_docs.withColumnRenamed("_t", "decoded").withColumnRenamed("_key", "tokens").withColumnRenamed("_row", "n_tokens")
    got = bpe.decode(bpe.encode(clash, PATH), PATH)
    assert set(got.columns) == {*clash.columns} and got.count() == 11
    for r in got.collect():
        assert r.decoded == (r.text or "") and ids(r.tokens) == both[1].encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.tokens) // 4
    assert bpe.encode(no_docs, PATH).isEmpty()
    nulls = spark.createDataFrame([(None,)], "tokens binary")
    assert bpe.decode(nulls, PATH).first().decoded == ""


def test_query(spark, both):
    import hashlib
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_bpe"](spark, SF_MID).collect()
    assert len(got) == len(texts)
    for r in got:
        want = both[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(want, skip_special_tokens=False).encode()).hexdigest()
