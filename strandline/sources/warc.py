"""WARC files as a Spark data source, read and write.

    register(spark)
    spark.read.format("warc").load("a.warc.gz,b.tar")

Each task streams its files record by record and hands Arrow batches to Spark;
only one record and one batch are in memory.  Small files are read several to a task.
A large file is read by many tasks where its member offset index says at which bytes
records begin; the sink writes one beside each file, and ``write_offsets`` makes them
for others in one pass.  A file without it, or a tar, is one task.

Filters on the kind of record and on the URL (equal, one of, beginning with) are
taken over by the reader where ``spark.sql.python.filterPushdown.enabled`` is set when
``register`` is called: other records are skipped after their header.  Without it Spark
filters the rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import sys
import tarfile
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import pairwise
from uuid import uuid4

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

SUFFIXES = (".warc", ".warc.gz", ".tar", ".tar.gz")
SCHEMA = (
    "file string, record_id string, rec_type string, ts timestamp, url string, status int, mime string,"
    " bytes bigint, digest string, redirect_to string, user_agent string, headers map<string,string>, body binary,"
    " capture_id string, concurrent_to string, refers_to_url string, refers_to_ts timestamp"
)
ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("record_id", pa.string()),
        ("rec_type", pa.string()),
        ("ts", pa.timestamp("us", tz="UTC")),
        ("url", pa.string()),
        ("status", pa.int32()),
        ("mime", pa.string()),
        ("bytes", pa.int64()),
        ("digest", pa.string()),
        ("redirect_to", pa.string()),
        ("user_agent", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("body", pa.binary()),
        ("capture_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to_url", pa.string()),
        ("refers_to_ts", pa.timestamp("us", tz="UTC")),
    ]
)
BATCH_BYTES = 16 << 20
TASK_BYTES = 128 << 20
ROLLOVER_BYTES = 1_000_000_000
OFFSETS = ".offsets"  # what a file's member offset index adds to its name
# Kinds of record whose block is an HTTP message.
HTTP_KINDS = ("request", "response", "revisit")


class UnsupportedArchive(ValueError):
    """The file name has none of the accepted endings."""


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(paths: str) -> list[tuple[str, int]]:
    """(path, size) of a comma list of files, folders and globs."""
    from pyarrow import fs

    found = []
    for path in (p.strip() for p in paths.split(",")):
        system, inner = _filesystem(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        if "*" in inner:
            base = inner[: inner.index("*")].rpartition("/")[0]
            wanted = re.compile(re.escape(inner).replace(r"\*", "[^/]*") + "(/.*)?")
            inside = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            matched = [f for f in inside if f.is_file and wanted.fullmatch(f.path) and f.path.endswith(SUFFIXES)]
            if not matched:
                raise FileNotFoundError(f"no archive at {path}")
            found += [(prefix + f.path, f.size) for f in matched]
            continue
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no archive at {path}")
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(inner, recursive=True))
            found += [(prefix + f.path, f.size) for f in inside if f.is_file and f.path.endswith(SUFFIXES)]
        elif path.endswith(SUFFIXES):
            found.append((path, info.size))
        else:
            raise UnsupportedArchive(f"{path} does not end in {', '.join(SUFFIXES)}")
    return found


def _headers(stream) -> list[tuple[str, str]]:
    """Header lines up to the empty line; continuation lines are joined."""
    out: list[tuple[str, str]] = []
    while line := stream.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Start line, headers (lower case, repeats joined) and body of a message."""
    stream = io.BytesIO(block)
    start = stream.readline().decode("utf-8", "replace").strip()
    fields: dict[str, str] = {}
    for name, value in _headers(stream):
        fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return start, fields, stream.read()


def _timestamp(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text).astimezone(timezone.utc) if text else None
    except ValueError:
        return None


def _chunks(body: bytes) -> bytes:
    """A chunked body put together; what is no chunk ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size) or not int(size, 16):
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def decoded(body: bytes, fields: dict[str, str]) -> bytes:
    """The body without transfer and content coding; as it is where it is coded
    otherwise than its headers say."""
    if "chunked" in fields.get("transfer-encoding", "").lower() and re.match(rb"[0-9a-fA-F]{1,8}\s*(;[^\r]*)?\r\n", body):
        body = _chunks(body)
    coding = fields.get("content-encoding", "").lower().strip()
    windows = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in windows:
        try:
            return _inflated(body, bits)
        except zlib.error:
            continue
    return body


def _inflated(body: bytes, bits: int) -> bytes:
    """All members of a coded body; what follows the last one is no content."""
    coder = zlib.decompressobj(bits)
    out = [coder.decompress(body)]
    while bits == 31 and coder.eof and (rest := coder.unused_data.lstrip(b"\0")):
        coder = zlib.decompressobj(bits)
        try:
            out.append(coder.decompress(rest))
        except zlib.error:
            break
    return b"".join(out)


def records(
    stream, file: str, decode: bool = False, first: int = 0, wanted: Callable[[str | None, str | None], bool] | None = None
) -> Iterator[dict]:
    """The records of one WARC stream, as rows of SCHEMA.  A payload digest that
    the header lacks is taken of the body; a record without id is named by its file
    and number.  ``first`` is the number of the first record; records whose kind and
    URL are not ``wanted`` are passed over."""
    number = first - 1
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: expected a record, found {line[:40]!r}")
        number += 1
        head = dict(_headers(stream))
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{file}: the last record is cut short")
        url = head.get("warc-target-uri", "").strip("<>") or None
        if wanted is not None and not wanted(head.get("warc-type"), url):
            continue
        status, fields, body = None, {}, block
        is_http = head.get("content-type", "").startswith("application/http")
        if is_http:
            start, fields, body = _http(block)
            code = start.split(" ")[1:2]
            if start.startswith("HTTP/") and code and code[0].isdigit():
                status = int(code[0])
        digest = head.get("warc-payload-digest")
        if digest is None and head.get("warc-type") in ("response", "resource"):
            digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        if decode:
            body = decoded(body, fields)
        record_id = head.get("warc-record-id")
        mime = fields.get("content-type") if is_http else head.get("content-type")
        yield {
            "file": file,
            "record_id": record_id,
            "rec_type": head.get("warc-type"),
            "ts": _timestamp(head.get("warc-date")),
            "url": url,
            "status": status,
            "mime": mime.split(";")[0].strip().lower() if mime else None,
            "bytes": size,
            "digest": digest,
            "redirect_to": fields.get("location"),
            "user_agent": fields.get("user-agent"),
            "headers": list(fields.items()),
            "body": body,
            "capture_id": record_id or f"{file}#{number}",
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to_url": head.get("warc-refers-to-target-uri", "").strip("<>") or None,
            "refers_to_ts": _timestamp(head.get("warc-refers-to-date")),
        }


class Span(io.RawIOBase):
    """The bytes of a file from one offset up to another."""

    def __init__(self, raw, start: int, end: int):
        self.raw, self.left = raw, end - start
        raw.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


def open_streams(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, object]]:
    """(name, byte stream) of a file or a part of it, or of each WARC inside a tar."""
    system, inner = _filesystem(path)
    if end is not None:
        with system.open_input_file(inner) as raw:
            part = io.BufferedReader(Span(raw, start, end), 1 << 20)
            yield path, gzip.open(part) if path.endswith(".gz") else part
        return
    with system.open_input_stream(inner, compression=None) as raw:
        if path.endswith((".tar", ".tar.gz")):
            with tarfile.open(fileobj=raw, mode="r|*") as tar:
                for member in tar:
                    if member.isfile() and member.name.endswith((".warc", ".warc.gz")):
                        data = tar.extractfile(member)
                        yield f"{path}!{member.name}", gzip.open(data) if member.name.endswith(".gz") else data
        elif path.endswith(".gz"):
            yield path, gzip.open(raw)
        else:
            yield path, io.BufferedReader(raw)


def read_offsets(path: str) -> array | None:
    """Where the records of a file begin, and where the last one ends; None without an
    index."""
    from pyarrow import fs

    system, inner = _filesystem(path + OFFSETS)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    found = array("q")
    with system.open_input_stream(inner, compression=None) as stream:
        found.frombytes(stream.read())
    if sys.byteorder == "big":
        found.byteswap()
    return found


def _store_offsets(system, inner: str, offsets: array) -> None:
    if sys.byteorder == "big":
        offsets = array("q", offsets)
        offsets.byteswap()
    with system.open_output_stream(inner, compression=None) as stream:
        stream.write(offsets.tobytes())


def member_offsets(path: str, step: int = 1 << 20) -> array | None:
    """The offsets of a file's records, found by one pass: of gzip members, or by the
    lengths that plain records state.  None if a member is not one whole record."""
    system, inner = _filesystem(path)
    with system.open_input_stream(inner, compression=None) as raw:
        return _gzip_offsets(raw, step) if path.endswith(".gz") else _plain_offsets(raw)


def _gzip_offsets(raw, step: int) -> array | None:
    out, at, data = array("q"), 0, raw.read(step)
    while data:
        coder, head, size = zlib.decompressobj(31), b"", 0
        out.append(at)
        while not coder.eof:
            if not data:
                raise ValueError("the last member is cut short")
            shown = coder.decompress(data, step)
            head, size = (head + shown)[: max(len(head), 1 << 16)], size + len(shown)
            used = len(data) - len(coder.unconsumed_tail) - len(coder.unused_data)
            at += used
            data = coder.unconsumed_tail or coder.unused_data or (b"" if coder.eof else raw.read(step))
        lines, mark, _ = head.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", lines)
        if not head.startswith(b"WARC/") or not mark or not length or not 0 <= size - len(lines) - 4 - int(length[1]) <= 4:
            return None
        data = data or raw.read(step)
    out.append(at)
    return out


def _plain_offsets(raw) -> array | None:
    stream, out, at = io.BufferedReader(raw), array("q"), 0
    while line := stream.readline():
        if line.strip():
            if not line.startswith(b"WARC/"):
                return None
            out.append(at)
            size = 0
            while line.strip():
                at += len(line)
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
                line = stream.readline()
            at += len(line) + size
            while size:
                part = stream.read(min(size, 1 << 20))
                if not part:
                    return None
                size -= len(part)
        else:
            at += len(line)
    out.append(at)
    return out


def write_offsets(spark: SparkSession, paths: str) -> DataFrame:
    """Make the member offset index of files that have none, a task a file: (file,
    records).  A file whose members are not single records gets none, and null; tars
    have none either."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    files = [(path,) for path, _ in list_files(paths) if not path.endswith((".tar", ".tar.gz"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                offsets = read_offsets(path)
                if offsets is None:
                    offsets = member_offsets(path)
                    if offsets is not None:
                        system, inner = _filesystem(path + OFFSETS)
                        _store_offsets(system, inner + ".tmp", offsets)
                        system.move(inner + ".tmp", inner)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None if offsets is None else len(offsets) - 1], pa.int64())], ["file", "records"])

    table = spark.createDataFrame(files, "file string").repartition(max(1, len(files)), "file")
    done = table.mapInArrow(run, "file string, records bigint").toArrow()
    return spark.createDataFrame(done)


@dataclass
class Files(InputPartition):
    """Files, each with its first byte, the byte after its last, and the number of
    its first record; no bytes mean the whole file."""

    parts: list[tuple[str, int, int | None, int]]

    @property
    def paths(self) -> list[str]:
        return [path for path, *_ in self.parts]


class WarcScan(DataSourceReader):
    """Reads the files and leaves all filters to Spark, which refuses a reader that takes
    filters over where that is not enabled."""

    def __init__(self, options: dict[str, str]):
        self.files = list_files(options["path"])
        self.decode = options.get("decode", "false").lower() == "true"
        self.body = options.get("body", "true").lower() == "true"
        self.types = {t.strip() for t in options.get("types", "").split(",") if t.strip()}
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.pushed: list[tuple[str, str, tuple[str, ...]]] = []

    def wanted(self, rec_type: str | None, url: str | None) -> bool:
        if self.types and rec_type not in self.types:
            return False
        for column, test, values in self.pushed:
            value = rec_type if column == "rec_type" else url
            if value is None or test == "in" and value not in values or test == "starts" and not value.startswith(values[0]):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Large files by themselves, in ranges of whole records where an index says
        where they begin; small ones packed up to the task size."""
        tasks, current, filled = [], [], 0
        for path, size in sorted(self.files, key=lambda f: (-f[1], f[0])):
            offsets = read_offsets(path) if size > self.task_bytes else None
            if offsets is not None and len(offsets) > 2:
                count = -(-size // self.task_bytes)
                edges = sorted({bisect_left(offsets, size * k // count) for k in range(count)} | {0, len(offsets) - 1})
                tasks += [Files([(path, offsets[a], offsets[b], a)]) for a, b in pairwise(edges)]
                continue
            if current and filled + size > self.task_bytes:
                tasks.append(Files(current))
                current, filled = [], 0
            current.append((path, 0, None, 0))
            filled += size
        return tasks + [Files(current)] if current else tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, start, end, first in partition.parts:
            for name, stream in open_streams(path, start, end):
                for row in records(stream, name, self.decode, first, self.wanted):
                    if not self.body:
                        row["body"] = None
                    rows.append(row)
                    held += 512 + len(row["body"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class WarcReader(WarcScan):
    """Takes filters over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over tests of the kind and the URL; gives back all others."""
        for test in filters:
            column = test.attribute[0] if len(getattr(test, "attribute", ())) == 1 else None
            if column not in ("rec_type", "url"):
                yield test
            elif isinstance(test, EqualTo) and isinstance(test.value, str):
                self.pushed.append((column, "in", (test.value,)))
            elif isinstance(test, In) and all(isinstance(v, str) for v in test.value):
                self.pushed.append((column, "in", tuple(test.value)))
            elif isinstance(test, StringStartsWith):
                self.pushed.append((column, "starts", (test.value,)))
            elif isinstance(test, IsNotNull):
                self.pushed.append((column, "known", ()))
            else:
                yield test


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """One or more ``.warc.gz`` files per task, a gzip member per record.  Files
    get their final name only when the whole job commits.

    Nothing is made up: what a row does not say is left out.  A message without
    status has ``-`` in its place, which reads back as null; kinds that are no HTTP
    message are written with their own type and body only."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("rolloverSize", ROLLOVER_BYTES))
        self.info = options.get("info", "")
        system, inner = _filesystem(self.path)
        system.create_dir(inner, recursive=True)

    def _member(self, head: list[tuple[str, object]], block: bytes) -> bytes:
        lines = [f"{k}: {v}" for k, v in head if v is not None]
        lines += [f"Content-Length: {len(block)}", "", ""]
        return gzip.compress(b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + block + b"\r\n\r\n", 6)

    def _warcinfo(self) -> bytes:
        head = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"),
            ("Content-Type", "application/warc-fields"),
        ]
        return self._member(head, f"software: strandline\r\n{self.info}\r\n".encode())

    def _record(self, row: dict) -> bytes:
        kind = row.get("rec_type") or "response"
        body = bytes(row.get("body") or b"")
        head = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid4()}>"),
            ("WARC-Date", _stamp(row.get("ts"))),
            ("WARC-Target-URI", row.get("url")),
            ("WARC-Payload-Digest", row.get("digest")),
            ("WARC-Concurrent-To", row.get("concurrent_to")),
            ("WARC-Refers-To-Target-URI", row.get("refers_to_url")),
            ("WARC-Refers-To-Date", _stamp(row.get("refers_to_ts"))),
        ]
        if kind not in HTTP_KINDS:
            return self._member([*head, ("Content-Type", row.get("mime"))], body)
        fields = dict(row.get("headers") or {})
        if row.get("mime") and "content-type" not in fields:
            fields["content-type"] = row["mime"]
        if row.get("user_agent") and kind == "request":
            fields.setdefault("user-agent", row["user_agent"])
        if row.get("redirect_to"):
            fields.setdefault("location", row["redirect_to"])
        status = row.get("status")
        start = f"HTTP/1.1 {'-' if status is None else status} -"
        if kind == "request":
            target = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "", row.get("url") or "").partition("#")[0]
            start = f"GET {target if target.startswith('/') else '/' + target} HTTP/1.1"
        http = "\r\n".join([start, *[f"{k}: {v}" for k, v in fields.items()], "", ""]).encode()
        message = "request" if kind == "request" else "response"
        return self._member([*head, ("Content-Type", f"application/http; msgtype={message}")], http + body)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.path)
        files: list[tuple[str, str]] = []
        out, size, offsets = None, 0, array("q")

        def done() -> None:
            out.close()
            last = files[-1][1]
            files.append((last + OFFSETS + ".tmp", last + OFFSETS))
            _store_offsets(system, files[-1][0], offsets + array("q", [size]))

        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    if out is None or size > self.limit:
                        if out:
                            done()
                        final = f"{folder}/part-{uuid4().hex}.warc.gz"
                        files.append((final + ".tmp", final))
                        out, info = system.open_output_stream(final + ".tmp", compression=None), self._warcinfo()
                        out.write(info)
                        size, offsets = len(info), array("q", [0])
                    data = self._record(batch.slice(at, 1).to_pylist(maps_as_pydicts="lossy")[0])
                    out.write(data)
                    offsets.append(size)
                    size += len(data)
            if out:
                done()
        except BaseException:
            if out:
                out.close()
            _each(system.delete_file, [(temporary,) for temporary, _ in files])
            raise
        return Written(files)

    def commit(self, messages) -> None:
        system, _ = _filesystem(self.path)
        _each(system.move, [pair for message in messages if message for pair in message.files])

    def abort(self, messages) -> None:
        system, _ = _filesystem(self.path)
        _each(system.delete_file, [(temporary,) for message in messages if message for temporary, _ in message.files])


def _each(act, arguments: list[tuple]) -> None:
    """Many small calls to a store, side by side."""
    with ThreadPoolExecutor(32) as pool:
        list(pool.map(lambda a: act(*a), arguments))


def _stamp(ts: datetime | None) -> str | None:
    return None if ts is None else ts.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcScan:
        return WarcScan(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("the warc sink only appends")
        return WarcWriter(self.options)


class FilteringWarcSource(WarcSource):
    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, with pushed filters if the session has them enabled;
    call it again after that setting changes.  The code travels with the plan, so
    executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    spark.dataSource.register(FilteringWarcSource if pushed else WarcSource)
