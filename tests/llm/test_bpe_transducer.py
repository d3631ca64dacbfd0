"""The transducer against the reference tokenizer and against BPE by definition."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from strandline.llm import bpe_transducer as bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = [
    "a", "b", " ", "  ", "\n", "\t", "é", "1", "²", "'s", "'", "ß", "Σ", "中文", "🎉", "\x1c", "\x85", " ", "the", "ing", "aaaa",
    "  \n ", ".", "...", "́", "​", "﻿", "　", "\x0b", "<|endoftext|>", "\x00", "ThE", "%%%",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def whole(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, public_tokenizers.PATTERN)


def test_random_texts(whole, codec):
    rng = random.Random(1)
    for _ in range(8_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert codec.encode(text) == whole.encode_ordinary(text)
        assert "".join(codec.decode(codec.encode(text))) == text


def test_random_characters(whole, codec):
    rng = random.Random(2)
    for _ in range(5_000):
        kinds = (rng.randint(32, 126), rng.randint(97, 122), rng.randint(0, 0x2FFF), rng.randint(0x10000, 0x1FFFF))
        text = "".join(chr(rng.choice(kinds)) for _ in range(rng.randint(0, 12)))
        assert codec.encode(text) == whole.encode_ordinary(text)


def test_bounds_change_nothing(ranks, whole, monkeypatch):
    """Memo and machine start anew all the time."""
    for name in ("MEMO", "STATES", "PAIRS", "DECODE_TOKENS"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = "The quick, brown 🎉 foxes' dens — 中文 über alles. " * 3
    assert small.encode(text) == whole.encode_ordinary(text)
    assert "".join(small.decode(small.encode(text))) == text


def test_other_ranks_by_definition():
    """A small vocabulary with overlapping merges of all lengths."""
    rng = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)}
    pool = [b"a", b"b", b"c"]
    while len(ranks) < 330:
        token = rng.choice(pool) + rng.choice(pool)
        if token not in ranks:
            ranks[token] = len(ranks)
            pool.append(token)
    machine = bpe.Transducer(ranks)
    for _ in range(5_000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 24)))
        assert machine.encode_word(word) == bpe.merge_ranks(ranks, word)


def test_lookahead_is_bounded(codec):
    """Tokens come out on the way through a long word, not all at its end."""
    machine, state, waiting = codec.machine, codec.machine.start, 0
    longest = max(len(t) for t in machine.tokens.values())
    for byte in (b"incomprehensibilities" * 50):
        state, emitted = machine.step(state, byte)
        waiting += 1 - sum(len(machine.tokens[t]) for t in emitted)
        assert waiting <= 2 * longest


def test_table(spark, whole):
    schema = "doc_id bigint, text string, n_tokens string, ids string, bpe_text string"
    texts = [None, "", "a", "word " * 30_000, "a" * 20_000, "Hello  world\n"] * 2
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], schema)
    found = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN, ids=True).collect()
    for row in found:
        text = texts[row.doc_id] or ""
        ids = whole.encode_ordinary(text)
        assert (row.ids, row.n_tokens) == (ids, len(ids))
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(found) == len(texts)
    assert bpe.encode_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_a_smaller_memo_has_a_smaller_machine(ranks, whole, monkeypatch):
    """The pipeline's workers went over an executor's memory with a whole machine behind a part of the memo."""
    for name, most in (("MEMO", 400), ("STATES", 400), ("PAIRS", 400)):
        monkeypatch.setattr(bpe, name, most)
    small = bpe.Codec(ranks, public_tokenizers.PATTERN, 100)
    text = " ".join(f"{i * 7919} wörd{i} incomprehensibilities" for i in range(400))
    assert small.encode(text) == whole.encode_ordinary(text)
    assert len(small.machine.states) <= 100 and len(small.machine.pairs) <= 100
