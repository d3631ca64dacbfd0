"""Alignment of two tokenizers against offsets compared one by one."""

import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandline.llm import token_alignment as T

SCHEMA = "doc_id bigint, text string, chunk string, link string, id string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(both, text):
    """[(id, start, end)] of A and of B, or nothing."""
    a, b = both
    if not text:
        return [], []
    decode = {}
    for x in range(256):  # the usual table of bytes and visible characters
        decode[len(decode)] = x
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(x): x for x in shown}
    names |= {chr(256 + i): x for i, x in enumerate([x for x in range(256) if x not in shown])}
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    out.append([(i, bytes(names[c] for c in a.id_to_token(i))) for i in ids])
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    out.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in out):
        return [], []
    placed = []
    for side in out:
        at, found = 0, []
        for i, x in side:
            found.append((i, at, at + len(x)))
            at += len(x)
        placed.append(found)
    return placed


def by_loops(both, rows):
    aligned = []
    for doc_id, text, *_ in rows:
        a, b = tokens(both, text)
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        j, links = 0, []
        for i, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        aligned.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(p for r in aligned for p in set(r[4]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    return Counter((d, na, nb, ng, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha) for d, na, nb, ng, links, sha in aligned)


ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\na", "a \nb", "a\n b", "\ta\tb", "it's 12ab34", "▁a", "x▁", "é é ﬁ",
    "<|endoftext|> x <s> </s> <unk> <0x0A>", "日本語のテキスト 12 漢字", "\U0001f600 emoji \U0001f468‍\U0001f469", " nb sp   x", "tokenization of antidisestablishmentarianism",
    "a\x00b \x1c c", "don't we'll 'tis 's9", "   leading", "CamelCaseWORDS_and_more", "\r\nline\r\n", "word.\nNext word.\nLast",
]


def documents():
    rng = random.Random(8)
    words = ["the", "über", "naïve", "12", "3rd", "x", "日本", "foo_bar", "Hello,", "(see)", "é", "ing", "'s"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(80):
        rows.append((100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "", "  "]) for _ in range(rng.randint(1, 60)))))
    rows += [(300, "abc123 and 日本語 words\n" * 900), (301, "z" * 3_000), (302, "日本語" * 1_500), (303, "x▁y " * 900), (None, "no id here"), *rows[100:104]]
    return [(*r, "x", "y", "z") for r in rows]


@pytest.mark.parametrize(("long", "piece", "chunk"), [(1 << 16, 1 << 14, 400_000), (200, 64, 50), (5, 3, 1)])
def test_by_loops(spark, both, long, piece, chunk):
    rows = documents()
    if piece == 3:
        rows = rows[:100]
    found = T.align(spark.createDataFrame(rows, SCHEMA).repartition(4), *PATHS, long=long, piece=piece, chunk_size=chunk).collect()
    assert Counter(map(tuple, found)) == by_loops(both, rows)


def test_composing_is_associative(both):
    rng = random.Random(4)
    spell = lambda f: (f.prefix, f.text, f.n.tolist(), f.links.tolist(), f.times.tolist(), f.suffix, f.cut)
    for _, text, *_ in documents():
        a, b = tokens(both, text)
        if not a or len(a) > 400:
            continue
        sides = [([x[0] for x in side], [x[2] for x in side]) for side in (a, b)]
        cuts = [sorted(rng.sample(range(len(s[0]) + 1), min(3, len(s[0])))) for s in sides]
        pieces = []
        for k in range(max(map(len, cuts)) + 1):
            part = []
            for s, c in zip(sides, cuts):
                edges = [0, *c, *[len(s[0])] * 5]
                part.append((s[0][edges[k] : edges[k + 1]], s[1][edges[k] : edges[k + 1]]))
            pieces.append(T.fragment(*part))
        left = reduce(T.compose, pieces)
        right = reduce(lambda x, y: T.compose(y, x), reversed(pieces))
        whole = T.fragment(*sides)
        assert spell(left) == spell(right) == spell(whole)
        assert spell(T.compose(T.Fragment(), whole)) == spell(whole) == spell(T.compose(whole, T.Fragment()))


def test_pieces_are_cut_apart(both):
    own = T.pair(*PATHS)
    text = "abc123 and 日本語 words\n" * 50
    pieces = list(own.pieces(text, 40))
    assert "".join(p[1] for p in pieces) == " " + text and "".join(p[3] for p in pieces) == text
    assert any(p[0] != p[2] for p in pieces[1:])  # A and B are not cut at the same places


def test_no_rows(spark):
    assert T.align(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []
