"""Token counts and the codec against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assay.llm import bpe, bpe_codec, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary.of(open(PATH, encoding="utf-8").read())


def strange(n=300):
    r = random.Random(5)
    spans = [(9, 0x7F), (0x80, 0x250), (0x250, 0xD800), (0xE000, 0x110000)]
    return ["".join(chr(r.randrange(*r.choice(spans))) for _ in range(r.randrange(60))) for _ in range(n)]


TEXTS = ["", "a", "aaaaaaaa", "  \n\n x", "\x1c\x1d \x85 x y", "it's we'll I'VE", "a<|endoftext|>b<|endoftext|><|endoftext|>", "日本語 \U0001f642\U0001f642", "x" * 4000, "word " * 300_000, *strange()]


def test_ids_and_counts_equal_the_library(library, vocab):
    want = [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    codec, counter = bpe_codec.Codec(vocab), token_count.Counter(vocab)
    ids = codec.encode_all([*TEXTS, None])
    assert ids.to_pylist() == [*want, []]
    assert counter.counts([*TEXTS, None]) == [*map(len, want), 0]
    assert codec.decode_all(ids).to_pylist()[:-1] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_one_by_one_and_forgetting(library, vocab, monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 5)
    counter = token_count.Counter(vocab)
    some = TEXTS[:9] + ["one two three four five six seven eight nine ten " * 3]
    assert [counter.counts([t])[0] for t in some] == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_cuts_are_never_crossed(vocab):
    for raw in list(vocab.bytes.values())[:50256]:
        b = np.frombuffer(raw, np.uint8)
        assert not vocab.never_adjacent[b[:-1], b[1:]].any() or raw == b"<|endoftext|>"


def test_tables(spark, docs, library):
    rows = docs.withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    counted = token_count.with_budget(rows, PATH)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counted.collect())
    want = []
    for r in docs.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 512))
    assert got == sorted(want)
    both = bpe_codec.digests(bpe_codec.round_trip(rows, PATH))
    for r in both.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == (r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    decoded = bpe_codec.decode(bpe_codec.encode(docs.select("doc_id", "text"), PATH), PATH)
    assert all(r["decoded"] == (r["text"] or "") for r in decoded.collect())
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0
