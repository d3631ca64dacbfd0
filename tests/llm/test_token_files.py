"""Token files: exact round trips, and the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import token_files as files

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start string, tie string"


@pytest.fixture(scope="module")
def whole():
    found = Tokenizer.from_file(PATH)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 2, 300, 65_536, 1 << 32])
def test_round_trip(top):
    rng = np.random.default_rng(top)
    for size in (0, 1, 2, 255, 256, 257, 5_000):
        ids = rng.integers(0, top, size).astype(np.uint32)
        ids[: size // 50] = top - 1  # outliers together
        payload = files.pack(ids)
        assert (files.unpack(payload) == ids).all()
        for _ in range(5):
            first, last = sorted(rng.integers(0, size + 1, 2).tolist())
            assert (files.unpack(payload, first, last) == ids[first:last]).all()


def test_outliers_are_exceptions():
    ids = np.arange(256, dtype=np.uint32) % 8 + 1000
    plain = len(files.pack(ids))
    ids[7] = 1 << 31
    assert len(files.pack(ids)) == plain + 5
    assert (files.unpack(files.pack(ids)) == ids).all()


def test_words_one_by_one_are_whole_texts(whole, monkeypatch):
    rng = random.Random(2)
    pieces = [
        "a", "B", " ", "  ", "\n", "\t", "é", "1", "²", "'s", "ß", "ΑΣ", "中文", "🎉", "\x1c", "\x85", " ", "the", "́", "̸",
        "İ", ".", "ǅ", "<|endoftext|>", "<|ENDOFTEXT|>", "​", "　", "\x0b", "\x00",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(5_000)]
    monkeypatch.setattr(files, "MEMO", 50)
    found = files.Encoder(PATH).encode([t.encode() for t in texts])
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text)


def test_special_tokens_are_the_librarys(whole):
    """Their strings are special tokens as written, and text with other letters."""
    texts = ["hello <|endoftext|> x", "a <|startoftext|>b", "x<|endoftext|>y", "a <|ENDOFTEXT|> b", "A<|EndOfText|>B <|startoftext|", "<|endoftext|>", "plain |> text <|"]
    for text, ids in zip(texts, files.Encoder(PATH).encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text), text
    assert whole(texts[0])[1] == 49407 and 49407 not in whole(texts[3])


def test_files(spark, whole, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "SEGMENT", 50)
    rng = random.Random(4)
    texts = [None, "", "One two", "word " * 20_000] + [" ".join(rng.choices(["the", "Cat", "é", "99"], k=rng.randint(0, 40))) for _ in range(80)]
    rows = [(i * 7 % 84 - 5, t, None, None) for i, t in enumerate(texts)] + [(None, "no id", None, None)] * 2 + [(3, "again", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = str(tmp_path / "tokens")
    files.write_tokens(docs, out, PATH, end_id=2)
    found = sorted(files.read_documents(spark, out, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start, by_id = 0, {}
    for row in rows:
        by_id.setdefault(row[0], []).append([*whole(row[1]), 2])
    for row in found:
        assert row.ids in by_id[row.doc_id] and row.start == start
        assert row.n_tokens == len(row.ids) and row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        by_id[row.doc_id].remove(row.ids)
        start += row.n_tokens
    assert files.token_digest(docs.limit(0), PATH, 2).collect() == []
