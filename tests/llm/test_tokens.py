"""Token counts and BPE against greedy matching and the public library."""

import random

import pytest
from edges import edge_docs, edge_texts, none_of
from tokenizers import Tokenizer

from loomlog.llm import bpe, token_counts
from loomlog.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def tokens():
    return token_counts.byte_vocabulary(BYTE_BPE)


def greedy(word: bytes, known: set[bytes]) -> int:
    rest, n = b" " + word, 0
    while rest:
        size = next((k for k in range(min(len(rest), 200), 0, -1) if rest[:k] in known), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


def test_counts_are_those_of_greedy_matching(spark, tokens):
    docs, known = edge_docs(spark), set(tokens)
    rows = token_counts.token_counts(docs, tokens).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w, known) for w in words))
    assert token_counts.token_counts(none_of(docs), tokens).collect() == []


def test_links_skip_to_the_longest_tail():
    tokens = [b" a", b" abcd", b"b", b"c", b"bc", b"cdx", b"d", b"x", b" "]
    counter, known = token_counts.PieceCounter(tokens), set(tokens)
    rnd = random.Random(1)
    for _ in range(2000):
        word = "".join(rnd.choice("abcdxz") for _ in range(rnd.randrange(1, 12))).encode()
        assert counter.count(word) == greedy(word, known)


def test_ids_and_texts_come_back(spark):
    vocabulary, library = bpe.read_vocabulary(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    docs = edge_docs(spark)
    more = spark.createDataFrame([(100, "a <|endoftext|> b<|endoftext|>"), (101, "it's we'll 1234 !!  \n\n x\u00a0y")], "doc_id long, text string")
    encoded = bpe.encode(docs.select("doc_id", "text").unionByName(more), vocabulary)
    rows = bpe.decode(encoded, vocabulary).collect()
    assert len(rows) == docs.count() + 2
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    # a clashing column is replaced
    assert dict(bpe.encode(docs, vocabulary).dtypes)["ids"] == "array<int>"
    assert bpe.decode(bpe.encode(none_of(docs), vocabulary), vocabulary).collect() == []


def test_random_bytes_and_long_runs_merge_alike():
    encoder, library = bpe.Encoder(bpe.read_vocabulary(BYTE_BPE)), Tokenizer.from_file(BYTE_BPE)
    rnd = random.Random(2)
    for alphabet in ("ab", "aehst ", "0123 ,.", "".join(map(chr, range(0x20, 0x2500)))):
        for _ in range(40):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400)))
            assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in [t for t in edge_texts() if t]:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_long_text_is_cut_in_steps(monkeypatch):
    encoder = bpe.Encoder(bpe.read_vocabulary(BYTE_BPE))
    text = " some words  and\n lines 12" * 50
    whole = encoder.encode(text).tolist()
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert encoder.encode(text).tolist() == whole
