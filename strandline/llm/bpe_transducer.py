"""Byte-level BPE as a lazily determinised finite-state transducer.

The nondeterministic transducer walks the trie of all tokens and may end a token
wherever the trie has one, if BPE would leave that token and the one before it
side by side.  Exactly one of its paths spells a whole string: its BPE encoding.
The deterministic machine's states are sets of open paths.  Its transitions are
worked out when first met and then looked up.  A token is emitted as soon as all
open paths agree on it, which is after at most the length of the longest token.

Text is cut by the vocabulary's pattern before; whole stretches between single
spaces are looked up in a memo in front of the machine, and of a stretch that is not
there its single matches.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import KEPT, refuse_clash, small

MEMO = 200_000  # stretches kept; then the next generation starts
STATES = 120_000  # states kept at most; others are worked out again whenever they are met
PAIRS = 300_000
DECODE_TOKENS = 8192


def merge_ranks(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """BPE by definition: the lowest-ranked adjacent pair merges, leftmost first."""
    none = len(ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        rank = min(pairs)
        if rank == none:
            break
        at = pairs.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


class State:
    """A state of the deterministic machine: the last token emitted and the open
    paths, each a trie node and the tokens ended but not yet emitted.  The last path
    has just ended a token and stands at the root."""

    __slots__ = ("last", "paths", "steps")

    def __init__(self, last: int, paths: tuple[tuple[int, tuple[int, ...]], ...]):
        self.last, self.paths = last, paths
        self.steps: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks, self.most, self.most_pairs = ranks, max(1, int(STATES * share)), max(1, int(PAIRS * share))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: list[dict[int, int]] = [{}]  # the trie of all tokens
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][byte]
            self.ends[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        """Forget the deterministic machine but for the start of a word."""
        self.start = State(-1, ((0, ()),))
        self.states = {(-1, ((0, ()),)): self.start}
        self.unkept = 0

    def adjacent(self, left: int, right: int) -> bool:
        """Does BPE leave these two tokens side by side?  -1 is the word's start."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            before = b"" if left < 0 else self.tokens[left]
            want = [right] if left < 0 else [left, right]
            known = self.pairs[left, right] = merge_ranks(self.ranks, before + self.tokens[right]) == want
        return known

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Next state and the tokens emitted, when first met."""
        last, child, ends = state.last, self.child, self.ends
        moved, ended = [], None
        for node, pending in state.paths:
            node = child[node].get(byte)
            if node is None:
                continue
            if child[node]:
                moved.append((node, pending))
            token = ends[node]
            if ended is None and token >= 0 and self.adjacent(pending[-1] if pending else last, token):
                ended = (*pending, token)
        agreed = len(ended)
        for _, pending in moved:
            agreed = min(agreed, len(pending))
            while pending[:agreed] != ended[:agreed]:
                agreed -= 1
        emitted = ended[:agreed]
        if agreed:
            last, moved = ended[agreed - 1], [(node, pending[agreed:]) for node, pending in moved]
        key = last, (*moved, (0, ended[agreed:]))
        following = self.states.get(key)
        if following is None:
            following = State(*key)
            if len(self.states) >= self.most:
                self.unkept += 1
                return following, emitted
            self.states[key] = following
        state.steps[byte] = following, emitted
        return following, emitted

    def encode_word(self, word: bytes) -> list[int]:
        if self.unkept > 16 * self.most:  # the words are others than when the states were met
            self.restart()
        state, out = self.start, []
        for byte in word:
            known = state.steps.get(byte)
            state, emitted = known if known is not None else self.step(state, byte)
            if emitted:
                out += emitted
        out += state.paths[-1][1]  # the path that ends here
        return out


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int | None = None):
        self.most = MEMO if memo is None else memo
        self.machine = Transducer(ranks, min(1.0, self.most / MEMO))  # a smaller memo, a smaller machine
        self.words = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}  # () stands for a stretch that cannot be looked up
        self.older: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}  # matches that begin with no space
        self.names = {rank: str(rank) for rank in self.machine.tokens}

    def pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words(text):
            out += self.machine.encode_word(word.encode())
        return out

    def match(self, word: str) -> tuple[int, ...]:
        """Ids of one match of the pattern.  With a space before it, it is a stretch."""
        if word[0] == " " and len(word) > 1 and not word[1].isspace():
            found = self.memo.get(word[1:])
            return found or self.learn(word[1:])
        found = self.bare.get(word)
        if found is None:
            if len(self.bare) >= self.most // 4:
                self.bare.clear()
            found = self.bare[word] = tuple(self.machine.encode_word(word.encode()))
        return found

    def learn(self, stretch: str) -> tuple[int, ...]:
        """Ids of a space and the stretch after it; none where white space next to
        that space may change how the pattern cuts."""
        found = self.older.get(stretch)
        if found is None:
            plain = stretch and not (stretch[0].isspace() or stretch[-1].isspace())
            words = self.words(" " + stretch) if plain else []
            found = tuple(chain.from_iterable(map(self.match, words))) if len(words) > 1 else tuple(self.machine.encode_word(words[0].encode())) if words else ()
        if len(self.memo) >= self.most:
            self.memo, self.older = {}, self.memo
        self.memo[stretch] = found
        return found

    def encode(self, text: str) -> list[int]:
        """A single space between two other characters always begins a match of
        the pattern, so the text may be cut before each of them."""
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.pieces(text)
        parts = list(map(self.memo.get, rest))
        if None in parts:
            parts = [self.learn(s) if p is None else p for p, s in zip(parts, rest)]
        if () in parts:
            return self.pieces(text)
        return [*self.pieces(first), *chain.from_iterable(parts)]

    def spelled(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes of the ids, in runs."""
        tokens, ids = self.machine.tokens.__getitem__, list(ids)
        for at in range(0, len(ids), DECODE_TOKENS):
            yield b"".join(map(tokens, ids[at : at + DECODE_TOKENS]))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in runs, by an incremental UTF-8 state machine: a character cut
        between two runs is held back until its last byte is there."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for run in self.spelled(ids):
            yield state.decode(run)
        yield state.decode(b"", final=True)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, memo: int | None = None) -> Codec:
    """One per worker process: the vocabulary is installed on every machine."""
    return Codec(read_ranks(path), pattern, memo)


SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, memo: int = MEMO) -> DataFrame:
    """The ``keep`` columns of every row and n_tokens, ids_sha256 (of the decimal
    ids joined by single spaces), decoded_sha256 (of the bytes decoded from those
    ids), and with ``ids`` the ids themselves as array<int>.

    Null and empty texts have no ids.  One scan, no shuffle; memory is bounded by
    the longest text, ``memo`` (stretches a worker keeps, some 250 bytes each, twice)
    and the bounds above, of which a smaller memo takes its share.  No rows give no rows.
    ``keep`` may not hold one of the names added.
    """
    refuse_clash(keep, SCHEMA + ", ids array<int>" * ids)
    schema = docs.select(*keep).schema
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("bpe_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, memo)
        names = own.names
        KEPT["bpe"] = codec.cache_clear
        for batch in small(batches, keeps="bpe"):
            counts, hashes, decoded, lists = [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                found = own.encode(text)
                counts.append(len(found))
                hashes.append(hashlib.sha256(" ".join([names[i] for i in found]).encode()).hexdigest())
                back = hashlib.sha256()
                for part in own.spelled(found):
                    back.update(part)
                decoded.append(back.hexdigest())
                if ids:
                    lists.append(array("i", found))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names_out = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names_out.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names_out)

    return rows.mapInArrow(run, ", ".join([*kept, SCHEMA, *["ids array<int>"] * ids]))
