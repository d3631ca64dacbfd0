"""Token ids in files of patched frame-of-reference blocks.

A file (Parquet, so that any store Spark writes to will do) holds segments: whole
documents in ascending order of their ids, with a directory of document ids and
lengths, and a payload.  A payload, little-endian throughout::

    4 bytes "PFOR", uint32 ids, uint32 blocks
    uint32 start of each block within the payload, and the end of the last
    blocks of 256 ids (the last may be shorter): uint32 minimum, uint8 width,
        uint16 exceptions, then the ids less the minimum, packed at that width,
        then the place (uint8) of each exception, and what exceeds (uint32)

The width of a block is the bits that 90 % of its ids need.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.batches import KEPT, small
from strandline.session import scratch

BLOCK = 256
PERCENT = 90
SEGMENT = 1 << 16  # a segment ends with the document that reaches so many ids
MEMO = 900_000  # words kept; then all are learned anew
ROWS = 1_024  # texts that are Python objects at a time
GROUP = 1 << 22  # bytes of texts that are cut into words at a time, and one text more
#: Kinds of bytes: 0 ASCII white space, 1 lower-case letters and digits, 2 ASCII punctuation, 3 others.
KIND = np.full(256, 3, np.uint8)
KIND[list(b"\t\n\x0b\x0c\r ")] = 0
KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
MARKS = (b"\xcc", b"\xcd")  # first bytes of U+0300 to U+036F

HEAD = struct.Struct("<4sII")
BLOCK_HEAD = struct.Struct("<IBH")


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, ``width`` bits each, low bits first."""
    rows, count = values.shape
    whole = values.astype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(whole.view(np.uint8).reshape(rows, count, -1), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(rows, -1), axis=1, bitorder="little")


def _unpacked(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.zeros((len(rows), count, 16 if width <= 16 else 32), np.uint8)
    bits[:, :, :width] = np.unpackbits(rows, axis=1, bitorder="little")[:, : count * width].reshape(len(rows), count, width)
    whole = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
    return whole.view("<u2" if width <= 16 else "<u4").astype(np.uint32)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _blocks(ids: np.ndarray) -> list[bytes]:
    """Encode rows of equally many ids."""
    rows, count = ids.shape
    least = ids.min(axis=1)
    above = ids - least[:, None]
    need = _bits(above)
    widths = np.partition(need, (count * PERCENT + 99) // 100 - 1, axis=1)[:, (count * PERCENT + 99) // 100 - 1]
    odd = need > widths[:, None]
    exceptions = odd.sum(axis=1)
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        low = above[here] & np.uint32((1 << int(width)) - 1)
        packed = _packed(low, int(width)) if width else np.zeros((len(here), 0), np.uint8)
        for row, body in zip(here, packed):
            block = BLOCK_HEAD.pack(least[row], width, exceptions[row]) + body.tobytes()
            if exceptions[row]:
                places = np.flatnonzero(odd[row])
                block += places.astype(np.uint8).tobytes() + (above[row, places] >> np.uint32(width)).astype("<u4").tobytes()
            out[row] = block
    return out


def pack(ids: np.ndarray) -> bytes:
    """A payload; no ids give one without blocks."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    whole = len(ids) // BLOCK * BLOCK
    blocks = _blocks(ids[:whole].reshape(-1, BLOCK)) if whole else []
    if whole < len(ids):
        blocks += _blocks(ids[whole:].reshape(1, -1))
    first = HEAD.size + 4 * (len(blocks) + 1)
    starts = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4")
    return b"".join([HEAD.pack(b"PFOR", len(ids), len(blocks)), starts.astype("<u4").tobytes(), *blocks])


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (default: all) of a payload.  Only the blocks that
    hold them are read, by the index of block starts."""
    magic, count, blocks = HEAD.unpack_from(payload)
    if magic != b"PFOR":
        raise ValueError("not a token payload")
    last = count if last is None else min(last, count)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", blocks + 1, HEAD.size)
    lo, hi = first // BLOCK, (last + BLOCK - 1) // BLOCK
    out = np.zeros((hi - lo) * BLOCK, np.uint32)
    heads = [BLOCK_HEAD.unpack_from(payload, starts[b]) for b in range(lo, hi)]
    data = np.frombuffer(payload, np.uint8)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for at, (_, width, _) in enumerate(heads):
        by_shape.setdefault((width, min(BLOCK, count - (lo + at) * BLOCK)), []).append(at)
    table = out.reshape(-1, BLOCK)
    for (width, size), where in by_shape.items():
        if width:
            long = (size * width + 7) // 8
            from_ = starts[lo:hi][where].astype(np.int64) + BLOCK_HEAD.size
            table[where, :size] = _unpacked(data[from_[:, None] + np.arange(long)], width, size)
    for at, (least, width, odd) in enumerate(heads):
        size = min(BLOCK, count - (lo + at) * BLOCK)
        if odd:
            from_ = int(starts[lo + at]) + BLOCK_HEAD.size + (size * width + 7) // 8
            places = data[from_ : from_ + odd]
            more = np.frombuffer(payload, "<u4", odd, from_ + odd)
            table[at, places] |= more << np.uint32(width)
        table[at] += np.uint32(least)
    return out[first - lo * BLOCK : last - lo * BLOCK]


def lowered(text: bytes) -> bytes:
    return text if MARKS[0] in text or MARKS[1] in text else text.lower()


def cut(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of texts that may be encoded one by one; the place of each
    piece's spelling among them, text after text; and the number of pieces up to the
    beginning of each text, and in all."""
    held = np.frombuffer(b" ".join(texts), np.uint8)
    kind = KIND[held]
    solid = kind > 0
    first = np.r_[True, ~solid[:-1]][solid] if len(held) else solid
    rows = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    in_front = np.array([np.count_nonzero(solid[a:b]) for a, b in zip(np.r_[0, rows[:-1]], rows)], np.int64).cumsum()
    kind, held = kind[solid], held[solid]
    mark = kind == 2
    last = np.r_[first[1:], True] if len(held) else first
    run_ends = np.flatnonzero(mark & (last | ~np.r_[mark[1:], False]))
    tails = np.flatnonzero(mark[1:] & ~first[1:] & (kind[:-1] == 1)) + 1
    tails = tails[last[run_ends[np.searchsorted(run_ends, tails)]]]
    first[tails] = True
    starts = np.flatnonzero(first)
    edges = np.r_[starts, len(held)].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(held)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.r_[np.searchsorted(starts, in_front), len(starts)]


class Encoder:
    """Whole texts to ids by the tokenizers library.

    The vocabulary drops white space before it cuts words, so words between ASCII
    white space are encoded one by one, each once while it stays in the memo.  It
    also lowers all letters and cuts a word from the punctuation after it; both are
    done before, so that fewer words differ (letters not where a mark may follow,
    since some letters compose with a mark in one case only).  A text that spells a
    special token, which the library then takes for one, is encoded whole.

    A word's place in the memo says where its ids are in one array, so the ids of many
    texts are taken in one go."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        self.tokenizer.encode_special_tokens = True  # lowered words may spell one
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # of tokens that end a word
        self.ends[[number for name, number in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.starts, self.sizes, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.memo)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at : at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(words)] = sizes
        self.memo.update(zip(words, range(at, at + len(words))))
        self.used += len(ids)

    def learn(self, words: Iterable[bytes]) -> None:
        """Make sure that the memo holds these words.  Words of letters only have
        one token that ends a word each, so many are encoded in one text."""
        plain, other = [], []
        for word in words:
            (plain if word.decode().isalpha() else other).append(word)
        (whole,) = self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)
        ids = np.array(whole.ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(plain):
            self.keep(plain, ids, np.diff(ends, prepend=0))
        else:
            other += plain
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
        self.keep(other, np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64))

    def whole(self, text: bytes) -> bytes:
        """A text with special tokens, as the library encodes it."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < GROUP:
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            yield from self._encode(some)

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        special = [any(s in t for s in self.special) for t in texts]
        words, index, edges = cut([b"" if odd else lowered(t) for t, odd in zip(texts, special)])
        known = list(map(self.memo.get, words))
        new = [word for word, at in zip(words, known) if at is None]
        if new:
            if len(self.memo) >= MEMO:
                self.forget()
                new = words
            self.learn(new)
            known = list(map(self.memo.__getitem__, words))
        place = np.array(known, np.int64)[index]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[place] - ends + sizes, sizes) + np.arange(int(sizes.sum()))].tobytes()
        edges = (4 * np.r_[0, ends][edges]).tolist()
        for text, odd, a, b in zip(texts, special, edges[:-1], edges[1:]):
            yield self.whole(text) if odd else ids[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SEGMENTS = "part int, part_start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order
    of the documents' ids (null first; rows with one id by a hash of the text).

    One range shuffle of id and text.  Null and empty texts have the end id only.
    No rows give no segments.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = {
                "part": part, "part_start": start, "n_ids": len(ids), "doc_ids": [d for d, _ in held],
                "lengths": [len(x) // 4 for _, x in held], "payload": pack(ids),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema(KINDS))

        KEPT["words"] = encoder.cache_clear
        for batch in small(batches, rows=ROWS, keeps="words"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist())):
                held.append((doc_id, ids + end))
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield segment()
                    start, held, size = start + size, [], 0
        if held:
            yield segment()

    rows.select("doc_id", "text").mapInArrow(segments, SEGMENTS).write.parquet(out)


KINDS = [
    ("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
]


def read_segments(spark, out: str) -> DataFrame:
    """The segments with ``start``, the ids of all segments before.  Only totals of
    the written partitions, one number each, are summed in one place and broadcast."""
    stored = spark.read.parquet(out)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return stored.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_documents(spark, out: str, ids: bool = False) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents
    before), n_tokens, ids_crc32 (of the ids as little-endian uint32), and with
    ``ids`` the ids as array<bigint>."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                doc_ids, lengths, payload, start = (one.column(c)[0].as_py() for c in ("doc_ids", "lengths", "payload", "start"))
                found = unpack(payload).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(found[a:b].tobytes()) for a, b in zip(starts, ends)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    columns.append(pa.array([found[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return read_segments(spark, out).select("doc_ids", "lengths", "payload", "start").mapInArrow(documents, schema)


def token_digest(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a new folder and read back."""
    out = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, end_id, id_col, text_col)
    return read_documents(docs.sparkSession, out)
