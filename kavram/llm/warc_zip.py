"""Operator 3, reader (and writer) of web archives packaged as ZIP.

A package holds archive members (``archive/*.warc.gz`` or ``.warc``), which are
stored in the ZIP without further compression, and index members
(``indexes/*.cdx``, ``.cdxj`` or ``.cdx.gz``), whose lines give each record's offset
and length in its archive. Reading a package takes its last bytes (the end record,
and that of ZIP64 where there is one), its central directory, its indexes, and
then only the ranges of the records. Nothing is extracted.

The work is in two steps: packages give *splits*, neighbouring records of up to
``split_bytes``, and the splits are spread over the cluster and read. An archive
without index lines is one split that is walked record by record.

Defined results
  * One row for each ``response`` or ``resource`` record; others are skipped.
    Repeated records give repeated rows, order isn't defined.
  * ``url`` is null without WARC-Target-URI, ``page_id`` without Page-Id; ``html`` is
    null for HTTP status 204, which is how the writer keeps nulls, and else the
    body as UTF-8 (bytes that aren't become U+FFFD). Records may be of any length.
  * Whatever is damaged gives one row with ``error`` set and the rest null, and
    all else of the package is read: a file that isn't a ZIP, a central directory
    cut short (the members before the cut are read), a member whose entry or local
    header is broken, an archive that isn't stored (it can't be read by range), a
    record whose range doesn't hold one, an index line or an index that can't be
    read. In the last two cases the index may lack records, so the archives of
    the package are walked instead, up to the first damage in each.
  * A Page-Id that isn't a whole number of 64 bits is null, and so is a status of
    other than three digits.
  * The writer reads the id, url and html columns only; ids that aren't whole
    numbers become null. Control characters in an url are percent-encoded. Empty
    tables write no package; an empty list of packages gives no rows.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import shared_folder, written

_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ARCHIVE = re.compile(r"archive/.+\.warc(\.gz)?$")
_INDEX = re.compile(r"indexes/.+\.cdxj?(\.gz)?$")
_STATUS, _NUMBER = re.compile("[0-9]{3}"), re.compile("[+-]?[0-9]{1,19}")
_BUFFER = 1 << 20


class BrokenPackage(ValueError):
    pass


#: What damaged bytes raise in the parsers of this module and the library's.
_FAULTS = (ArithmeticError, EOFError, LookupError, OSError, TypeError, ValueError, struct.error, zlib.error)


@dataclass(frozen=True)
class Member:
    """offset: of the local header. packed, size: bytes in the ZIP and unpacked. fault: what is wrong with its entry."""

    name: str
    method: int
    packed: int
    size: int
    offset: int
    fault: str | None = None


ReadAt = Callable[[int, int], bytes]  # (offset, bytes)


def members(read_at: ReadAt, size: int) -> Iterator[Member]:
    """The central directory; an error comes after the members before it."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0:
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise BrokenPackage("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != _LOCATOR64:
            raise BrokenPackage("no locator of the ZIP64 end of central directory")
        at = struct.unpack_from("<Q", tail, end - 20 + 8)[0]
        record = read_at(at, 56)
        if len(record) < 56 or record[:4] != _END64:
            raise BrokenPackage("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    if offset + length > size:
        length = max(0, size - offset)
    directory = read_at(offset, length) if length else b""
    at = 0
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL or at + 46 > len(directory):
            raise BrokenPackage("central directory cut short")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        sizes = [whole, packed, header]
        while len(extra) >= 4 and 0xFFFFFFFF in sizes:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: 8 bytes for each field that is all ones, in this order
                field = extra[4 : 4 + n]
                for i, x in enumerate(sizes):
                    if x == 0xFFFFFFFF and len(field) >= 8:
                        sizes[i], field = struct.unpack_from("<Q", field)[0], field[8:]
            extra = extra[4 + n :]
        fault = f"{name}: no ZIP64 sizes" if 0xFFFFFFFF in sizes else None
        yield Member(name, method, sizes[1], sizes[0], sizes[2], fault)
        at += 46 + n_name + n_extra + n_comment


def data_offset(read_at: ReadAt, member: Member) -> int:
    header = read_at(member.offset, 30)
    if len(header) < 30 or header[:4] != _LOCAL:
        raise BrokenPackage(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.offset + 30 + n_name + n_extra


def contents(read_at: ReadAt, member: Member) -> bytes:
    """A small member, unpacked."""
    raw = read_at(data_offset(read_at, member), member.packed)
    if member.method == 8:
        raw = zlib.decompress(raw, -15)
    elif member.method:
        raise BrokenPackage(f"{member.name}: method {member.method}")
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def index_lines(raw: bytes) -> Iterator[tuple[str, int, int] | str]:
    """(archive, offset, length) of lines ``key timestamp {json}``, or what is wrong with
    one; others, headers too, are skipped."""
    for number, line in enumerate(raw.decode("utf-8", "replace").splitlines(), 1):
        at = line.find("{")
        if at < 0 or line.startswith("!"):
            continue
        try:
            fields = json.loads(line[at:])
            if "offset" in fields and "length" in fields:
                yield str(fields.get("filename") or ""), int(fields["offset"]), int(fields["length"])
        except (*_FAULTS, RecursionError) as e:
            yield f"line {number}: {e}"


def _opened(uri: str) -> tuple[ReadAt, int, io.IOBase]:
    files, path = pafs.FileSystem.from_uri(uri)
    file = files.open_input_file(path)
    return (lambda offset, n: file.read_at(n, offset)), file.size(), file


def splits_of(read_at: ReadAt, size: int, split_bytes: int) -> Iterator[tuple[int, int, list[int], list[int], str | None]]:
    """(begin, bytes, offsets, lengths, error): offsets from begin; without any, the range is walked."""

    def wrong(what) -> tuple[int, int, list[int], list[int], str | None]:
        return 0, 0, [], [], str(what) or type(what).__name__

    found: list[Member] = []
    lines: dict[str, list[tuple[int, int]]] = {}
    complete = True
    try:
        for m in members(read_at, size):
            found.append(m)
    except _FAULTS as e:
        yield wrong(e)
        complete = False  # an index may lie behind the cut
    for m in found:
        if _INDEX.search(m.name):
            try:
                if m.fault:
                    raise BrokenPackage(m.fault)
                for line in index_lines(contents(read_at, m)):
                    if isinstance(line, str):
                        yield wrong(f"{m.name}, {line}")
                        complete = False
                    else:
                        lines.setdefault(line[0].rpartition("/")[2], []).append(line[1:])
            except _FAULTS as e:
                yield wrong(f"{m.name}: {e}")
                complete = False
    archives = [m for m in found if _ARCHIVE.search(m.name)]
    for m in archives:
        try:
            if m.fault or m.method:
                raise BrokenPackage(m.fault or f"{m.name} isn't stored")
            begin = data_offset(read_at, m)
        except _FAULTS as e:
            yield wrong(e)
            continue
        own = sorted(lines.get(m.name.rpartition("/")[2]) or (lines.get("", []) if len(archives) == 1 else [])) if complete else []
        if not own:
            yield begin, m.packed, [], [], None
        first, last = 0, 0
        part: list[tuple[int, int]] = []
        for offset, n in own:
            if offset < 0 or n < 0 or offset + n > m.packed:
                yield wrong(f"{m.name}: no record at {offset}")
                continue
            if part and max(last, offset + n) - first > split_bytes:
                yield begin + first, last - first, [o - first for o, _ in part], [x for _, x in part], None
                part = []
            if not part:
                first, last = offset, offset
            part.append((offset, n))
            last = max(last, offset + n)
        if part:
            yield begin + first, last - first, [o - first for o, _ in part], [x for _, x in part], None


class _Range(io.RawIOBase):
    """A range of a file as a stream."""

    def __init__(self, read_at: ReadAt, begin: int, size: int):
        self.read_at, self.at, self.end = read_at, begin, begin + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.read_at(self.at, min(len(buffer), self.end - self.at))
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


class _Gunzip(io.RawIOBase):
    """The members of a gzip stream, unpacked as they come: what lies before damage is given first."""

    def __init__(self, source: io.BufferedIOBase):
        self.source, self.member, self.rest, self.out = source, None, b"", b""

    def readable(self) -> bool:
        return True

    def _more(self) -> bool:
        raw = self.rest or self.source.read1(1 << 16)
        if not raw:
            if self.member is not None:
                raise BrokenPackage("gzip member cut short")
            return False
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.out = self.member.decompress(raw, _BUFFER)
        self.rest = self.member.unconsumed_tail or self.member.unused_data
        if self.member.eof:
            self.member = None
        return True

    def readinto(self, buffer) -> int:
        while not self.out:
            if not self._more():
                return 0
        part, self.out = self.out[: len(buffer)], self.out[len(buffer) :]
        buffer[: len(part)] = part
        return len(part)


def _walk(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records of a WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise BrokenPackage("no WARC record")
        header: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            header[key.strip().lower()] = value.strip()
        n = int(header.get("content-length", 0))
        if n < 0:
            raise BrokenPackage("negative length of a record")
        block = stream.read(n)
        if len(block) < n:
            raise BrokenPackage("record cut short")
        yield header, block


def _page_id(text: str | None) -> int | None:
    if text is None or not _NUMBER.fullmatch(text):
        return None
    number = int(text)
    return number if -(1 << 63) <= number < 1 << 63 else None


def records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(page_id, url, status, mime, html) of the response and resource records of a stream, which may be gzipped."""
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Gunzip(stream), 1 << 16)
    for header, block in _walk(stream):
        kind = header.get("warc-type")
        status, mime, body = None, header.get("content-type"), block
        if kind == "response":
            head, _, body = block.partition(b"\r\n\r\n")
            top, *fields = head.decode("utf-8", "replace").split("\r\n")
            parts = top.split()
            status = int(parts[1]) if len(parts) > 1 and _STATUS.fullmatch(parts[1]) else None
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
            mime = http.get("content-type", "").partition(";")[0] or None
            if http.get("content-encoding") == "gzip":
                body = gzip.decompress(body)
        elif kind != "resource":
            continue
        yield _page_id(header.get("page-id")), header.get("warc-target-uri"), status, mime, None if status == 204 else body.decode("utf-8", "replace")


SCHEMA = "page_id long, url string, status int, mime string, html string, error string"
_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
_NAMES = ("page_id", "url", "status", "mime", "html", "error")


def _plan(split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                try:
                    read_at, size, file = _opened(uri)
                    with file:
                        for split in splits_of(read_at, size, split_bytes):
                            rows.append(split)
                except _FAULTS as e:
                    rows.append((0, 0, [], [], str(e)))
                columns = list(zip(*rows)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], ["package", "begin", "size", "offsets", "lengths", "error"])

    return run


def _split_rows(uri: str, begin: int, size: int, offsets: list[int], lengths: list[int]) -> Iterator[tuple]:
    read_at, _, file = _opened(uri)
    with file:
        if not offsets:
            try:
                for row in records(io.BufferedReader(_Range(read_at, begin, size), _BUFFER)):
                    yield (*row, None)
            except _FAULTS as e:
                yield (*[None] * 5, str(e) or type(e).__name__)
            return
        data = memoryview(read_at(begin, size))
        for offset, n in zip(offsets, lengths):
            try:
                for row in records(io.BufferedReader(io.BytesIO(data[offset : offset + n]))):
                    yield (*row, None)
            except _FAULTS as e:
                yield (*[None] * 5, str(e) or type(e).__name__)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], list(_NAMES))

    for batch in batches:
        for package, begin, size, offsets, lengths, error in zip(*(c.to_pylist() for c in batch.columns)):
            if error is not None:
                yield out([(*[None] * 5, error)])
                continue
            rows, held = [], 0
            for row in _split_rows(package, begin, size, offsets, lengths):
                rows.append(row)
                held += len(row[4] or "")
                if held > 4 * _BUFFER:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read(packages: DataFrame, split_bytes: int = 8 << 20, splits_per_task: int = 2) -> DataFrame:
    """Rows of SCHEMA from packages, a table of one column of URIs."""
    plan = written(packages.mapInArrow(_plan(split_bytes), "package string, begin long, size long, offsets array<long>, lengths array<long>, error string"), "warc-splits")
    # by number: the splits' rows are small, and would be put together as one task's work
    tasks = max(1, -(-plan.count() // splits_per_task))
    return plan.repartition(tasks, "package", "begin").mapInArrow(_read, SCHEMA)


class _Sink(io.RawIOBase):
    """What zipfile needs of an output stream that can't seek."""

    def __init__(self, file):
        self.file = file

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.file.write(data)
        return len(data)


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    head = b"HTTP/1.1 204 No Content\r\nContent-Type: text/html\r\n\r\n" if html is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + (html or "").encode("utf-8", "replace")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _key(url: str) -> str:
    """Sort key of an url: host backwards, then the path."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + parts.path + (f"?{parts.query}" if parts.query else "")


def write_package(out, pages: Iterator[tuple[int | None, str | None, str | None]], level: int = 3) -> int:
    """Writes one package to a stream that needn't seek; the number of its records."""
    lines = []
    at = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open("archive/data.warc.gz", "w", force_zip64=True) as archive:
            for page_id, url, html in pages:
                data = gzip.compress(_record(page_id, url, html), level, mtime=0)
                archive.write(data)
                fields = {"url": _safe(url or ""), "mime": "text/html", "status": "204" if html is None else "200", "offset": str(at), "length": str(len(data)), "filename": "data.warc.gz"}
                lines.append(f"{_key(_safe(url or ''))} 20240101000000 {json.dumps(fields)}")
                at += len(data)
        lines.sort()
        package.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode(), level, mtime=0))
        package.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": p} for p in ("archive/data.warc.gz", "indexes/index.cdx.gz")]}))
    return len(lines)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A package for each partition of pages in folder; a table (package) of their URIs.
    A task writes under a name of its own attempt and renames at the end, so that
    lost and repeated tasks leave no half package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        first = next(rows, None)
        if first is None:
            return
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():05d}.wacz"
        draft = f"{path}/{name}.{task.taskAttemptId()}"
        with files.open_output_stream(draft) as file:
            write_package(_Sink(file), (r for part in ([first], rows) for r in part))
        files.move(draft, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["package"])

    slim = pages.select(F.col(page_id).try_cast("long"), F.col(url), F.col(html))
    return written(slim.mapInArrow(run, "package string"), "packages")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as packages to the shared folder and read back."""
    folder = f"{shared_folder(pages.sparkSession)}/wacz-{uuid.uuid4().hex}"
    return read(write(pages, folder))
