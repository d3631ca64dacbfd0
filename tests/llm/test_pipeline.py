"""The whole pipeline against its stages done by plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from test_mixing import by_loops
from test_simhash import slow_components, slow_fingerprint

import corpus_pipeline
from strandline.llm import bpe_transducer, ordinal_quality

SMOKE_DIR = "/root/testdata/sf0.001"


def slow_shingles(text):
    """Five words each, or all of fewer."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(spark, sf_dir):
    """Multiset of (doc_id, source, n_tokens, ids_sha256, decoded_sha256).  The
    model's own judgement is taken as given; all that follows is done anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = ordinal_quality.rate(docs, model, keep=("doc_id", "text", "source")).filter("keep").collect()
    groups = {}
    for r in rated:
        groups.setdefault("".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r"), []).append(r)
    by_id = lambda r: (r.doc_id is None, r.doc_id or 0)
    once = [min(g, key=lambda r: (-len(r.text or ""), *by_id(r))) for g in groups.values()]
    once.sort(key=by_id)
    fps = [slow_fingerprint(r.text) for r in once]
    root = slow_components(list(range(len(once))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    first = [r for i, r in enumerate(once) if root[i] == i]
    sets = [slow_shingles(r.text) for r in first]
    like = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = slow_components(list(range(len(first))), like)
    apart = [r for i, r in enumerate(first) if root[i] == i]
    rows = [(r.doc_id, r.text, r.source) for r in apart]
    whole = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    out = Counter()
    texts = {r[0]: r for r in rows}
    for doc_id, size, _, _, taken in by_loops(rows):
        _, text, source = texts[doc_id]
        ids = whole.encode_ordinary(text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        if size:
            out[doc_id, source, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()] += taken // size
    return +out


def result(spark, sf_dir, wordless=()):
    """Texts without a word have no size, so that the mix takes them tells nothing."""
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    return Counter(tuple(r) for r in found.collect() if r.doc_id not in wordless)


def test_given_documents(spark):
    assert result(spark, SMOKE_DIR) == by_hand(spark, SMOKE_DIR)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, None if i % 7 == 0 else r.lang, r.source if i % 5 else None, r.n_chars, "x", "y") for i, r in enumerate(docs)]
    rows += rows[:9] + [(1_000 + i, r[1], *r[2:]) for i, r in enumerate(rows[:9])]
    rows += [(2_000, None, None, None, None, None, None), (2_001, "", "en", "src1", 0, None, None), (2_002, " \n", None, "src2", None, None, None)]
    rows += [(2_003, "once more " * 30_000, "en", "src3", None, None, None), (None, "A row without an id is kept as well.", "en", "src1", None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_size string, dedup_h string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE_DIR}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 1), (6, 1, None)], labels.schema)).write.parquet(f"{out}/labels.parquet")
    return out


def test_odd_documents(spark, odd_dir):
    assert result(spark, odd_dir, wordless=(2_000, 2_001, 2_002)) == by_hand(spark, odd_dir)


def test_stages_return_documents_and_take_none(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, odd_dir)
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in docs.schema], name
        known = {repr(r) for r in docs.collect()}
        assert {repr(r) for r in found.collect()} <= known, name
        assert stage(spark, empty, odd_dir).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, odd_dir).collect() == []
