"""Ids by rank against the library on whole texts, and exact round trips."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from edges import edge_docs, none_of

from loomlog.llm import rank_bpe
from loomlog.llm.queries import BYTE_RANKS, rank_bpe_round_trip

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def told():
    return rank_bpe.read_ranks(BYTE_RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(told):
    return tiktoken.Encoding("own", pat_str=told["pattern"], mergeable_ranks=told["ranks"], special_tokens={})


def test_registered_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rank_bpe_round_trip(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_odd_rows(spark, told, library):
    docs = edge_docs(spark)
    rows = rank_bpe.decode(rank_bpe.encode(docs, told), told).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert rank_bpe.decode(rank_bpe.encode(none_of(docs), told), told).collect() == []
    one = spark.createDataFrame([(b"\x01\x00\x00\x00",), (None,), (b"",)], "ids binary")
    assert [bytes(r.decoded) for r in rank_bpe.decode(one, told).collect()] == [library.decode_bytes([1]), b"", b""]


def test_long_texts_are_cut_where_it_makes_no_difference(told, library):
    rnd = random.Random(8)
    bits = ["word", " it's", "'", "s", "42", "7 ", "  ", "\n", "　", "日本語", "é", "!?", "…", " x", "\x1c", "\x85", " ", "'ll", "٣", "́"]
    coder = rank_bpe.Coder(told)
    for size in (70_000, 150_000):
        text = "".join(rnd.choice(bits) for _ in range(size))
        assert coder.encode(text).tolist() == library.encode_ordinary(text)
    text = "a" * 200_000 + " " * 150_000 + "b1" * 50_000 + "日本" * 100_000 + "\n" * 100_000
    assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_every_cut_is_a_border_of_matches(told):
    rnd = random.Random(9)
    bits = ["a", "b", "'", "s", "'t", "4", " ", "\n", "!", "é", "日", "　", "\x1c", "²", "́"]
    matches = regex.compile(told["pattern"])
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12)))
        borders = {m.start() for m in matches.finditer(text)}
        for found in rank_bpe.SAFE.finditer(text):
            cut = found.start()
            assert cut in borders
            assert matches.findall(text[:cut]) + matches.findall(text[cut:]) == matches.findall(text)


def test_a_run_of_blanks_that_the_library_cannot_search(told, library):
    coder = rank_bpe.Coder(told)
    text = "x" + " " * 2_000_000 + "y" + "\t" * 1_500_000
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()
    blanks = coder.whole.encode_ordinary(" " * 1_999_999)
    assert ids.tolist()[1 : 1 + len(blanks)] == blanks
