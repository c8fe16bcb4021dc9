import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelode.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.BYTE_BPE_50K)), reason="no vocabulary files")


@pytest.fixture(scope="module")
def automaton():
    return bpe.load_automaton()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(bpe.TOKENIZERS, bpe.BYTE_BPE_50K))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinorst' \n019日本", max_size=60))
def test_same_ids_and_round_trip(text):
    automaton, reference = _both()
    ids = automaton.encode(text)
    assert ids == reference(text)
    assert automaton.decode(ids) == text


_cache = []


def _both():
    if not _cache:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(os.path.join(bpe.TOKENIZERS, bpe.BYTE_BPE_50K))
        t.encode_special_tokens = True
        _cache.append((bpe.load_automaton(), lambda s: t.encode(s, add_special_tokens=False).ids))
    return _cache[0]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 3000, "aaaaaaab" * 50, " " * 500, "\x00\x01​", "٣٤٥ ﬁle x̶y 𝒙", "日本語" * 200])
def test_odd_texts(automaton, reference, text):
    assert automaton.encode(text) == reference(text)


def test_small_automaton_equals_plain_merging():
    """All strings over two letters, against merging by rank until nothing merges."""
    merges = [(b"a", b"a"), (b"aa", b"b"), (b"b", b"a"), (b"aa", b"aa"), (b"aab", b"b")]
    vocab = {b"a": 0, b"b": 1} | {x + y: i + 2 for i, (x, y) in enumerate(merges)}
    automaton = bpe.MergeAutomaton(vocab, merges)

    def plain(word):
        parts = [bytes([c]) for c in word]
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranked:
                return [vocab[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 11):
        for k in range(1 << n):
            word = bytes(b"ab"[(k >> i) & 1] for i in range(n))
            assert automaton.encode_word(word) == plain(word)


def test_frames(spark, reference):
    texts = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, " \n", "x"), (4, " \n", "x"), (5, "word " * 20000, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    rows = bpe.encode_corpus(docs).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == sorted((k, reference(t) if t else []) for k, t, _ in texts)
    back = bpe.decode_corpus(bpe.encode_corpus(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((k, t or "") for k, t, _ in texts)
    assert {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(docs, ("doc_id",)).collect()}[3] == 0
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
