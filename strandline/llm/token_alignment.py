"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers, A and B, cut the same bytes.  Offsets at which tokens of both end cut
them into groups; tokens of a group that overlap are linked.  A *fragment* is what can
be said of neighbouring tokens of A and of B alone: an open prefix (tokens up to the
first common end, which may belong to a group begun before), closed groups, and an
open suffix (tokens after the last common end).  Two fragments compose by closing the
left one's suffix with the right one's prefix.  As the tokens of either tokenizer in a
fragment are without gaps, a group closed once stays closed, so composing is
associative and fragments may be reduced as a tree.

* A stretch between single spaces or newlines is a fragment without open ends, as both
  vocabularies cut there.  Such fragments are kept in a memo, and a text is their product.
* A text of more than ``LONG`` characters is cut where A may be cut and, apart from
  that, where B may be cut.  Its pieces are encoded by as many tasks, and their
  fragments reduced ``FAN`` at a time.

Counts of links over the corpus come next: documents are stored in chunks that list
their stretches once; a chunk hands on its distinct links with the number of its
documents that hold them.  Sums per link go back to the chunks that hold it, where a
document's figures are sums over its stretches.  So neither links nor tokens of a
document are shuffled, and a link that is everywhere is a row a chunk.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise, zip_longest

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import small
from strandline.session import written

MEMO = 400_000  # stretches kept; then all are learned anew
TOGETHER = 4_096  # stretches encoded as one text
LONG = 1 << 16  # characters
PIECE = 1 << 14
FAN = 16  # fragments composed at a time
CHUNK = 400_000  # stretches of documents after which a chunk ends
B_IDS = 1 << 15  # a link is A's id times this, plus B's id

#: Where A's pattern always begins a match, whatever is around.
A_CUT = regex.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

Tokens = tuple[list[int], list[int]]  # ids, and the offset at which each ends
NONE: Tokens = ([], [])


@dataclass
class Fragment:
    """``cut``: there is a common end; without one all tokens are in ``prefix`` and
    ``suffix`` is empty.  ``text`` spells the closed groups."""

    prefix: tuple[Tokens, Tokens] = (NONE, NONE)
    text: bytes = b""
    n: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))  # tokens of A, of B, groups
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # distinct
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    suffix: tuple[Tokens, Tokens] = (NONE, NONE)
    cut: bool = False
    differs: bool = False  # the bytes of A's or B's tokens are not the text's


#: The beginning of a text, a common end that closes nothing.
def beginning() -> Fragment:
    return Fragment(cut=True)


@dataclass
class Aligned:
    """Tokens of A and B over one range that both begin and end."""

    groups: np.ndarray  # where each group ends
    overlaps: np.ndarray  # where each overlap of two tokens ends
    links: np.ndarray  # of each overlap
    text: bytes  # all groups spelled, each with a semicolon after it
    text_ends: np.ndarray  # where each group's spelling ends


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of every id, and how many there are."""
    names = np.char.encode(np.arange(1 << 16).astype(str), "ascii").astype("S5")
    return names.view(np.uint8).reshape(-1, 5), np.char.str_len(names)


def aligned(a: Tokens, b: Tokens) -> Aligned:
    """All groups and links at once: any end of a token ends an overlap, and the
    tokens of the overlap are the first of A and of B that end there or later."""
    (a_ids, a_ends), (b_ids, b_ends) = (tuple(np.asarray(x, np.int64) for x in side) for side in (a, b))
    groups, overlaps = np.intersect1d(a_ends, b_ends, assume_unique=True), np.union1d(a_ends, b_ends)
    links = (a_ids[np.searchsorted(a_ends, overlaps)] * B_IDS + b_ids[np.searchsorted(b_ends, overlaps)]).astype(np.int32)
    a_group, b_group = np.searchsorted(groups, a_ends), np.searchsorted(groups, b_ends)
    a_last, b_last = (np.searchsorted(ends, groups, side="right") for ends in (a_ends, b_ends))  # tokens up to each group's end
    a_place = np.arange(len(a_ids)) + np.r_[0, b_last][a_group]
    b_place = np.arange(len(b_ids)) + a_last[b_group]
    ids, marks = np.empty(len(a_ids) + len(b_ids), np.int64), np.empty(len(a_ids) + len(b_ids), np.uint8)
    ids[a_place], ids[b_place] = a_ids, b_ids
    marks[a_place] = np.where(a_ends == groups[a_group], ord("|"), ord(","))
    marks[b_place] = np.where(b_ends == groups[b_group], ord(";"), ord(","))
    digits, widths = _digits()
    ends = np.cumsum(widths[ids] + 1)
    starts, text = ends - widths[ids] - 1, np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for place in range(digits.shape[1]):
        some = np.flatnonzero(widths[ids] > place)
        text[starts[some] + place] = digits[ids[some], place]
    text[ends - 1] = marks
    return Aligned(groups, overlaps, links, text.tobytes(), ends[b_place[b_last - 1]])


def closed(a: Tokens, b: Tokens) -> tuple[bytes, np.ndarray]:
    """The groups of a range, spelled, and the links of each overlap."""
    found = aligned(a, b)
    return found.text[:-1], found.links


def fragment(a: Tokens, b: Tokens, differs: bool = False) -> Fragment:
    """Of the tokens of A and B of one piece; their ranges need not be the same."""
    common = sorted(set(a[1]).intersection(b[1]))
    if not common:
        return Fragment(prefix=(a, b), differs=differs)
    split = lambda x: (x[1].index(common[0]) + 1, x[1].index(common[-1]) + 1)
    (a0, a1), (b0, b1) = split(a), split(b)
    part = lambda x, lo, hi: (x[0][lo:hi], x[1][lo:hi])
    text, links = closed(part(a, a0, a1), part(b, b0, b1))
    distinct, times = np.unique(links, return_counts=True)
    return Fragment(
        (part(a, 0, a0), part(b, 0, b0)), text, np.array([a1 - a0, b1 - b0, len(common) - 1]), distinct, times,
        (part(a, a1, None), part(b, b1, None)), True, differs,
    )


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of both, one after the other.  A fragment of no tokens is neutral."""
    joined = lambda x, y: (x[0] + y[0], x[1] + y[1])
    # Common ends may lie where an end of A is in one fragment and that of B in the other.
    open_ = left.suffix if left.cut else left.prefix
    middle = fragment(*(joined(x, y) for x, y in zip(open_, right.prefix)))
    differs = left.differs or right.differs
    if not left.cut and not right.cut:
        middle.differs = differs
        return middle
    parts = [left, middle, right]
    text, n, links = [x.text for x in parts], sum(x.n for x in parts), [(x.links, x.times) for x in parts]
    prefix = left.prefix if left.cut else middle.prefix
    suffix = right.suffix if right.cut else middle.suffix if middle.cut else middle.prefix
    if left.cut and middle.cut:  # a group of both
        more, more_links = closed(*middle.prefix)
        text.insert(1, more)
        n = n + np.array([len(middle.prefix[0][0]), len(middle.prefix[1][0]), 1])
        links.append((more_links, np.ones(len(more_links), np.int64)))
    distinct, place = np.unique(np.concatenate([x for x, _ in links]), return_inverse=True)
    times = np.zeros(len(distinct), np.int64)
    np.add.at(times, place, np.concatenate([x for _, x in links]))
    return Fragment(prefix, b";".join([t for t in text if t]), n, distinct, times, suffix, True, differs)


class Column:
    """Numbers in one growing array."""

    def __init__(self, kind: type = np.int64):
        self.kept, self.size = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.kept[self.size : self.size + len(values)] = values
        self.size += len(values)


class Units:
    """Closed fragments by name: how they are spelled, their figures and links."""

    def __init__(self):
        self.place: dict[object, int] = {}
        self.texts: list[bytes] = []
        self.n = [Column() for _ in range(3)]
        self.links, self.starts, self.sizes = Column(np.int32), Column(), Column()

    def add(self, names: list[object], texts: list[bytes], n: list[np.ndarray], links: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(names, range(len(self.texts), len(self.texts) + len(names))))
        self.texts += texts
        for column, values in zip(self.n, n):
            column.add(values)
        self.starts.add(self.links.size + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.links.add(links)

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the units one after the other, and how many each has."""
        sizes = self.sizes.kept[units]
        before = np.cumsum(sizes) - sizes
        return self.links.kept[np.repeat(self.starts.kept[units] - before, sizes) + np.arange(int(sizes.sum()))], sizes


UNUSABLE, DIFFERS = -1, -2  # places of stretches that cannot stand alone, and of those spelled differently


class Pair:
    """Both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # A's alphabet writes a byte as one character: itself if printable, else one from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte_of = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(hidden)}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(byte_of[c] for c in name) for name, i in names.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_sizes, self.b_sizes = (np.array([len(table.get(i, b"")) for i in range(max(table) + 1)]) for table in (self.a_bytes, self.b_bytes))
        #: Neighbouring characters of any piece; between others B never merges.
        self.b_inside = {x for i, p in enumerate(pieces) if not self.b.is_byte(i) for x in pairwise(p)}
        self.space, self.newline = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        self.by_words = not any(c1 != "▁" and c2 == "▁" or "\n" in (c1, c2) for c1, c2 in self.b_inside)
        self.units = Units()

    def of_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def of_b(self, texts: list[str], dropped: list[int]) -> list[list[int]]:
        """B's ids without the first few of each."""
        return [ids[k:] for ids, k in zip(self.b.encode(texts, num_threads=1), dropped)]

    def ends(self, ids: list[int], sizes: np.ndarray, start: int = 0) -> Tokens:
        return ids, (start + np.cumsum(sizes[ids])).tolist() if ids else []

    def whole(self, text: bytes, a: list[int], b: list[int], start: int = 0) -> Fragment:
        """The fragment of a range that A and B have both cut at either end; its prefix
        is the first group."""
        differs = any(b"".join([table[i] for i in ids]) != text for ids, table in ((a, self.a_bytes), (b, self.b_bytes)))
        if differs:
            return Fragment(differs=True)
        return compose(beginning(), fragment(self.ends(a, self.a_sizes, start), self.ends(b, self.b_sizes, start)))

    def learn(self, stretches: set[str]) -> None:
        """Fragments of stretches (what is between single spaces; or a newline and what
        follows it).  A stretch that begins or ends in other white space has none.  Both
        tokenizers cut between stretches, so that many are encoded as one text."""
        new, space, place = [], str.isspace, self.units.place
        for s in stretches:
            inner = s[1:] if s[:1] == "\n" else s
            if not inner or space(inner[0]) or space(inner[-1]):
                place[s] = UNUSABLE
            elif "▁" in s:
                place[s] = DIFFERS  # B spells it as a space
            else:
                new.append(s)
        new.sort(key=lambda s: s[0] == "\n")  # B's own space comes before the first
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            if some[0][0] == "\n":
                some.insert(0, "a")
            texts = [s if s[0] == "\n" else " " + s for s in some]
            whole = "".join(texts)
            (a,), (b,) = self.of_a([whole]), self.of_b([whole[1:]], [0])
            a, b = self.ends(a, self.a_sizes), self.ends(b, self.b_sizes)
            ends = np.cumsum([len(t.encode()) for t in texts])
            if not a[1][-1] == b[1][-1] == ends[-1]:
                raise ValueError("the tokenizers spell other bytes")
            found = aligned(a, b)
            cuts = [np.searchsorted(x, ends, side="right") for x in (a[1], b[1], found.groups, found.overlaps)]
            *n, sizes = (np.diff(c, prepend=0) for c in cuts)
            text_ends = found.text_ends[cuts[2] - 1].tolist()
            spelled = [found.text[i:j] for i, j in pairwise([0, *text_ends])]
            self.units.add(some, spelled, n, found.links, sizes)

    def prepare(self, texts: list[str]) -> list[np.ndarray | None]:
        """The units of each text's stretches; none if it cannot be cut so."""
        cut = [t.replace("\n", " \n").split(" ") if self.by_words else None for t in texts]
        place = self.units.place
        new = {s for c in cut if c for s in c}.difference(place)
        if new:
            self.learn(new)
        found = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) if c and c[0][:1] != "\n" else None for c in cut]
        return [None if units is None or UNUSABLE in units else units for units in found]

    def pieces(self, text: str, size: int = PIECE) -> Iterator[tuple[int, str, int, str]]:
        """(offset, text) for A and for B of each piece, cut independently."""

        def b_cut(at: int) -> int:
            shown = text[at - 1 :].replace(" ", "▁")
            return next((at + i for i, x in enumerate(pairwise(shown)) if x not in self.b_inside and x[1] != "▁"), len(text))

        def cuts(following: Callable[[int], int]) -> list[int]:
            out = [0]
            while out[-1] + size < len(text):
                out.append(following(out[-1] + size))
            return out if out[-1] == len(text) else [*out, len(text)]

        def a_cut(at: int) -> int:
            found = A_CUT.search(text, at)
            return found.start() if found else len(text)

        a_start, b_start = 0, 0
        for (a0, a1), (b0, b1) in zip_longest(pairwise(cuts(a_cut)), pairwise(cuts(b_cut)), fillvalue=(0, 0)):
            a_text, b_text = (" " if a0 == 0 and a1 else "") + text[a0:a1], text[b0:b1]
            yield a_start, a_text, b_start, b_text
            a_start += len(a_text.encode())
            b_start += len(b_text.encode()) + (b0 == 0 and b1 > 0)

    def piece(self, a_start: int, a_text: str, b_start: int, b_text: str) -> Fragment:
        (a,) = self.of_a([a_text])
        first = b_start == 0
        # A newline before the piece stands alone, so B's own space does not touch it.
        (b,) = self.of_b([b_text if first else "\n" + b_text], [0 if first else 2]) if b_text else ([],)
        want = ((a, self.a_bytes, a_text), (b, self.b_bytes, (" " if first else "") + b_text if b_text else ""))
        differs = any(b"".join([table[i] for i in ids]) != t.encode() for ids, table, t in want)
        return fragment(self.ends(a, self.a_sizes, a_start), self.ends(b, self.b_sizes, b_start), differs)


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One per worker process: the vocabularies are installed on every machine."""
    return Pair(a_path, b_path)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = (
    "chunk bigint, ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>,"
    " groups_sha256 array<string>, sizes array<int>, refs binary, word_sizes array<int>, word_links binary, links array<int>, n_docs array<bigint>"
)


class Chunk:
    """Documents that one task stores in a row: their stretches once, with their links."""

    def __init__(self, units: Units):
        self.units = units
        self.rows: list[tuple] = []  # id, figures, digest, and how many distinct units
        self.refs: list[np.ndarray] = []  # units of each document and how often
        self.distinct: list[np.ndarray] = []  # links of each document
        self.size = 0

    def add(self, ids: list[object], found: list[np.ndarray]) -> None:
        """Documents by the units they are the product of; none for a text without tokens."""
        of = self.units
        doc = np.repeat(np.arange(len(ids)), [len(units) for units in found])
        every = np.concatenate([np.zeros(0, np.int64), *found])
        keys, times = np.unique(doc << 32 | every, return_counts=True)
        doc, every = keys >> 32, keys & 0xFFFFFFFF
        links, sizes = of.links_of(every)
        each = [np.bincount(doc, times * values, len(ids)).astype(np.int64).tolist() for values in (*(c.kept[every] for c in of.n), sizes)]
        spelled = [b"".join(map(of.texts.__getitem__, units.tolist())) for units in found]
        digests = [hashlib.sha256(memoryview(t)[:-1]).hexdigest() if t else "" for t in spelled]
        self.rows += zip(ids, *each, digests, np.bincount(doc, minlength=len(ids)).tolist())
        self.refs.append(np.array([every, times], np.int64))
        self.distinct.append((np.unique(np.repeat(doc, sizes) << 32 | links) & 0xFFFFFFFF).astype(np.int32))
        self.size += len(every)

    def add_fragment(self, doc_id: object, whole: Fragment) -> None:
        """A document of its own fragment: each distinct link is a unit."""
        if whole.differs or not whole.n[0]:
            self.add([doc_id], [np.zeros(0, np.int64)])
            return
        names = whole.links.tolist()
        new = [x for x in names if x not in self.units.place]
        none = np.zeros(len(new), np.int64)
        self.units.add(new, [b""] * len(new), [none] * 3, np.array(new, np.int32), none + 1)
        units = np.array([self.units.place[x] for x in names], np.int64)
        self.rows.append((doc_id, *whole.n.tolist(), int(whole.times.sum()), hashlib.sha256(whole.text).hexdigest(), len(units)))
        self.refs.append(np.array([units, whole.times], np.int64))
        self.distinct.append(whole.links)
        self.size += len(units)

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        ids, n_a, n_b, n_groups, n_links, sha, sizes = map(list, zip(*self.rows))
        links, n_docs = np.unique(np.concatenate(self.distinct), return_counts=True)
        units, times = np.concatenate(self.refs, axis=1)
        words, places = np.unique(units, return_inverse=True)
        word_links, word_sizes = self.units.links_of(words)
        refs, word_links = (zlib.compress(x.tobytes(), 1) for x in (np.array([places, times], np.uint32), word_links))
        row = [number, ids, n_a, n_b, n_groups, n_links, sha, sizes, refs, word_sizes, word_links, links, n_docs]
        return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, schema.types)], schema=schema)


def _numbered(chunk: int) -> int:
    return (TaskContext.get().partitionId() << 32) + chunk


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _short_chunks(rows: DataFrame, paths: tuple[str, str], schema: str, chunk_size: int) -> DataFrame:
    """Chunks of (id, text) rows, one scan."""
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = pair(*paths), 0
        chunk = Chunk(own.units)
        for batch in small(batches, 64):
            ids, texts = (c.to_pylist() for c in batch.columns)
            whole = []
            found = own.prepare(texts)
            for i, (units, text) in enumerate(zip(found, texts)):
                if not text or units is not None and DIFFERS in units:
                    found[i] = np.zeros(0, np.int64)
                elif units is None:
                    whole.append(i)
            rest = [i for i in range(len(ids)) if found[i] is not None]
            chunk.add([ids[i] for i in rest], [found[i] for i in rest])
            for i in whole:
                (a,), (b,) = own.of_a([" " + texts[i]]), own.of_b([texts[i]], [0])
                chunk.add_fragment(ids[i], own.whole((" " + texts[i]).encode(), a, b))
            full = len(own.units.texts) >= MEMO
            if chunk.size >= chunk_size or full:
                yield chunk.batch(_numbered(number), arrow)
                own.units = Units() if full else own.units
                number, chunk = number + 1, Chunk(own.units)
        if chunk.rows:
            yield chunk.batch(_numbered(number), arrow)

    return rows.mapInArrow(run, schema)


TOKENS = "array<int>", "array<bigint>"
FRAGMENT = "doc bigint, no bigint, id {id}, cut boolean, differs boolean, text binary, n array<bigint>, links array<int>, times array<bigint>, " + ", ".join(
    f"{side}_{x}_{part} {kind}" for side in ("prefix", "suffix") for x in "ab" for part, kind in zip(("ids", "ends"), TOKENS)
)


def _packed(doc: int, no: int, doc_id: object, f: Fragment) -> list:
    open_ = [list(part) for side in (f.prefix, f.suffix) for tokens in side for part in tokens]
    return [doc, no, doc_id, f.cut, f.differs, f.text, f.n.tolist(), f.links, f.times, *open_]


def _unpacked(row: dict) -> Fragment:
    sides = [tuple((row[f"{side}_{x}_ids"], row[f"{side}_{x}_ends"]) for x in "ab") for side in ("prefix", "suffix")]
    links, times = np.array(row["links"], np.int32), np.array(row["times"], np.int64)
    return Fragment(sides[0], row["text"], np.array(row["n"], np.int64), links, times, sides[1], row["cut"], row["differs"])


def _rows(rows: list[list], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types)], schema=arrow)


def long_fragments(rows: DataFrame, paths: tuple[str, str], size: int = PIECE, fan: int = FAN) -> DataFrame:
    """(id, text) rows of long texts to one fragment each, from the beginning of the
    text.  Pieces of a text are encoded by many tasks and composed ``fan`` at a time."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    schema = FRAGMENT.format(id=kind)
    arrow = _arrow(spark, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, doc = pair(*paths), 0
        for batch in small(batches, 1):
            doc_id, text = batch.column(0), batch.column(1)[0].as_py()
            for no, piece in enumerate(own.pieces(text, size)):
                head = [pa.array([_numbered(doc)]), pa.array([no]), doc_id]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array([x]) for x in piece]], ["doc", "no", "id", "a_start", "a_text", "b_start", "b_text"])
            doc += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(*paths)
        for batch in small(batches, 16):
            yield _rows([_packed(r["doc"], r["no"], r["id"], own.piece(r["a_start"], r["a_text"], r["b_start"], r["b_text"])) for r in batch.to_pylist()], arrow)

    def reduce(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["no"])
        whole = _unpacked(found[0])
        for row in found[1:]:
            whole = compose(whole, _unpacked(row))
        return pa.Table.from_batches([_rows([_packed(found[0]["doc"], found[0]["no"] // fan, found[0]["id"], whole)], arrow)])

    pieces = written(rows.mapInArrow(cut, f"doc bigint, no bigint, id {kind}, a_start bigint, a_text string, b_start bigint, b_text string"), "align-pieces")
    parts = written(pieces.repartition("doc", "no").mapInArrow(encode, schema), "align-fragments")
    last = parts.agg(F.max("no")).first()[0] or 0
    while last:
        near = parts.withColumn("near", F.floor(F.col("no") / fan))
        parts = written(near.groupBy("doc", "near").applyInArrow(lambda table: reduce(table.drop_columns(["near"])), schema), "align-fragments")
        last //= fan
    return parts


def _long_chunks(fragments: DataFrame, schema: str, chunk_size: int) -> DataFrame:
    arrow = _arrow(fragments.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = 0, Chunk(Units())
        for batch in small(batches, 16):
            for row in batch.to_pylist():
                chunk.add_fragment(row["id"], compose(beginning(), _unpacked(row)))
                if chunk.size >= chunk_size:
                    yield chunk.batch(-1 - _numbered(number), arrow)
                    number, chunk = number + 1, Chunk(Units())
        if chunk.rows:
            yield chunk.batch(-1 - _numbered(number), arrow)

    return fragments.mapInArrow(run, schema)


def link_counts(chunks: DataFrame) -> DataFrame:
    """Per link: n_docs (documents that hold it) and best (no link of its A id has more)."""
    counts = chunks.select(F.explode(F.arrays_zip("links", "n_docs")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.n_docs").alias("n_docs"))
    counts = written(counts, "link-counts")
    of_a = F.expr(f"link div {B_IDS}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", of_a).join(most, "a").select("link", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
    long: int = LONG, piece: int = PIECE, chunk_size: int = CHUNK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best
    (links that as many documents hold as any link of their A id), count_sum (over links,
    the documents that hold them) and groups_sha256.

    A encodes a space and the text, B the text, before which it puts a space itself.
    Null and empty texts, and those whose tokens spell other bytes, have zeros and ''.
    Repeated rows and ids are rows and documents of their own; a null id stays null.  No
    rows give no rows; other columns of ``docs`` are not looked at."""
    paths, kind = (a_path, b_path), docs.schema[id_col].dataType.simpleString()
    schema = CHUNKS.format(id=kind)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.char_length("text") > long
    chunks = written(_short_chunks(rows.filter(~is_long), paths, schema, chunk_size), "align-chunks")
    fragments = long_fragments(rows.filter(is_long), paths, piece)
    chunks = chunks.unionByName(written(_long_chunks(fragments, schema, chunk_size), "align-chunks"))
    return figures(chunks, link_counts(chunks), kind)


def figures(chunks: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The documents of the chunks, with what the corpus says of their links."""
    held = chunks.select("chunk", F.explode("links").alias("link"))
    met = held.join(counts, "link").select(F.col("chunk").alias("of_chunk"), "link", "n_docs", "best")
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    arrow = _arrow(chunks.sparkSession, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        values = lambda c: row[c].values.to_numpy(zero_copy_only=False) if len(row[c].values) else np.zeros(0, np.int64)
        order = np.argsort(right.column("link").to_numpy())
        links = right.column("link").to_numpy()[order]
        found = np.searchsorted(links, np.frombuffer(zlib.decompress(row["word_links"].as_py()), np.int32))
        word = np.repeat(np.arange(len(values("word_sizes"))), values("word_sizes"))
        refs = np.frombuffer(zlib.decompress(row["refs"].as_py()), np.uint32).reshape(2, -1).astype(np.int64)
        doc = np.repeat(np.arange(len(row["sizes"].values)), values("sizes"))
        sums = []
        for c in ("best", "n_docs"):
            of_link = right.column(c).to_numpy().astype(np.int64)[order]
            of_word = np.zeros(len(values("word_sizes")), np.int64)
            np.add.at(of_word, word, of_link[found])
            of_doc = np.zeros(len(row["sizes"].values), np.int64)
            np.add.at(of_doc, doc, of_word[refs[0]] * refs[1])
            sums.append(pa.array(of_doc))
        columns = [row["ids"].values, *[row[c].values for c in FIGURES], *sums, row["groups_sha256"].values]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return chunks.groupBy("chunk").cogroup(met.groupBy("of_chunk")).applyInArrow(run, schema)
