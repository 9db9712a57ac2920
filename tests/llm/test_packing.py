import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliospark.llm import packing as K


def test_word_cache_equals_the_tokenizer(spark):
    path = K.tokenizer_path()
    whole, encode = Tokenizer.from_file(path), K.WordEncoder(path)
    texts = ["", "Hello, World!", "don't İstanbul ΣΑΣ ς'S ǅ ﬁ Å Å 12345 x²½", "<|endoftext|> a", "a\x85b\xa0c\x1cd  e　f \n\n g's", "a ́b ###*** x_y", "ÀÉ÷× tschüß, ẞ", "\U0001f600 ퟿"]
    for t in texts + [" ".join(texts)]:
        assert encode(t) == K._bytes(whole.encode(t, add_special_tokens=False).ids), t


def optimum(sizes, capacity):
    best = len(sizes)
    for assign in itertools.product(range(len(sizes)), repeat=len(sizes)):
        loads = [0] * len(sizes)
        for s, a in zip(sizes, assign):
            loads[a] += s
        if max(loads) <= capacity:
            best = min(best, sum(x > 0 for x in loads))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold(seed):
    sizes = np.sort(np.random.default_rng(seed).integers(1, 11, 5))[::-1]
    at, offset, free = K.best_fit(sizes, 10)
    best = optimum(sizes.tolist(), 10)
    assert K.lower_bound(sizes, capacity=10) <= best <= len(free)
    assert (np.bincount(at, sizes) + free == 10).all()
    for b in range(len(free)):
        mine = np.flatnonzero(at == b)
        assert offset[mine].tolist() == (np.cumsum(sizes[mine]) - sizes[mine]).tolist()


def test_bounds_beat_the_sum():
    assert K.lower_bound(np.array([6] * 5), capacity=10) == 5
    assert K.lower_bound(np.array([4] * 6), capacity=10) == 3


def test_exchange_between_partitions(spark):
    """Many small partitions each leave a gap; exchanging documents closes it."""
    rows = [(i, 0, 0, 700 + i % 300, i) for i in range(400)]
    packed, figures = K.pack_pieces(spark.createDataFrame(rows, K.PIECES), a_partition=40)
    assert figures["bins"] <= figures["rounds"][0] and figures["bins"] <= figures["bound"] * 1.12
    got = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(got) == figures["bins"] and all(r[1] <= 4096 for r in got) and packed.count() == 400


def test_exchange_saves_bins(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(300, 2000, 600))]
    packed, figures = K.pack_pieces(spark.createDataFrame(rows, K.PIECES), a_partition=20)
    assert figures["bins"] < figures["rounds"][0] and figures["bins"] <= 1.08 * figures["bound"]
    got = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert len(got) == figures["bins"] and all(r[1] <= 4096 for r in got)
    assert sorted(r.doc_id for r in packed.collect()) == list(range(600))


def test_pieces_and_places(spark, odd):
    packed, _ = K.pack_documents(odd)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(K.tokenizer_path())
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(str(r.doc_id), k, at, len(p := ids[at : at + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert K.pack_documents(odd.limit(0))[0].count() == 0


def test_new_words_of_many_texts_are_encoded_together(monkeypatch):
    """Words are learned a chunk of texts at a time, letters by few calls, and ids stay those of the tokenizer, also as caches start anew."""
    path = K.tokenizer_path()
    whole, draw = Tokenizer.from_file(path), np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEÀÉÎÖØÞßàéîöøþÿ")
    texts = [" ".join("".join(draw.choice(letters, draw.integers(1, 12))) + str(draw.choice(["", "", ",", ".&&", "'s", "9"])) for _ in range(60)) for _ in range(50)]
    texts += ["", "a\x1cB <|endoftext|>", "ſ K Å İ ﬁ"]
    want = [K._bytes(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    encode, calls = K.WordEncoder(path), []
    learn = encode._learn_letters
    monkeypatch.setattr(encode, "_learn_letters", lambda new: (calls.append(len(new)), learn(new)))
    assert encode.encode(texts) == want and len(calls) == 1 and calls[0] > 1000
    monkeypatch.setattr(K, "CACHED_WORDS", 20)
    assert encode.encode(texts[::-1]) == want[::-1] and [encode(t) for t in texts] == want
