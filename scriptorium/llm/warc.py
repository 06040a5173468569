"""WARC files: a normaliser for those that are compressed as one gzip stream.

Such a file can only be read from its beginning. The normaliser inflates the stream once, piece by piece, writes every
record as a gzip member of its own, and a sidecar index with each record's offset and length, so that a record can be
read by itself. A task handles whole files and holds a few hundred kilobytes of each, however long its records are.

Files are reached through pyarrow's file systems, so that the folder may be local, HDFS or an object store. Output
appears under its final name only once it is complete, so that a task that is run again, or twice, does no harm.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Generator, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, table_dir

PIECE = 1 << 18
#: How a gzip member starts: magic number and deflate.
MEMBER = b"\x1f\x8b\x08"
#: A record's head may have so many bytes.
HEAD = 1 << 20
LEVEL = 6
#: Level of the whole-file streams that :func:`write_monolithic` makes.
LEVEL_MONOLITHIC = 1
PAGE_HEADER = "WARC-Page-Id"
INDEX_SCHEMA = "file string, record bigint, page_id bigint, url string, offset bigint, length bigint, content_length bigint, content_sha1 string, status string"
_FIELDS = [x.split() for x in INDEX_SCHEMA.split(", ")]


# --- streams ---


class Break:
    """Stands in a stream of pieces where it can't be inflated; what comes after it is of a later member."""


def inflated(raw: BinaryIO) -> Generator[bytes | Break, None, bool]:
    """Pieces of what a gzip stream holds, of one member or of many; zeros may follow a member.

    Where the stream is damaged comes a :class:`Break`, and reading goes on at the next place that looks like the start of
    a member. Returns whether the stream ends within a member.
    """
    inflate, begun = zlib.decompressobj(31), False
    ended = False  # a member has; what follows may be padding
    lost, told = False, False  # looking for the next member; the break has been told of, and nothing came since
    kept = b""
    while data := raw.read(PIECE):
        data = kept + data
        kept = b""
        while data:
            if lost:
                at = data.find(MEMBER)
                if at < 0:
                    kept = data[-len(MEMBER) + 1 :]
                    break
                data, lost = data[at:], False
            if ended and not begun and not (data := data.lstrip(b"\0")):
                break
            begun, before = True, data
            try:
                piece = inflate.decompress(data, 4 * PIECE)
            except zlib.error:
                if not told:
                    yield Break()
                told = True
                inflate, begun, ended, lost = zlib.decompressobj(31), False, True, True
                data = before[1:]
                continue
            if piece:
                told = False
                yield piece
            if inflate.eof:
                data = inflate.unused_data
                inflate, begun, ended = zlib.decompressobj(31), False, True
            else:
                data = inflate.unconsumed_tail
    if begun and (tail := inflate.flush()):
        yield tail
    return begun and not inflate.eof


class Pieces:
    """Reads a stream of pieces up to a mark, or a number of bytes. ``broken``: the stream has ended within a member. ``damaged``: it stands before a break."""

    def __init__(self, pieces: Iterator[bytes | Break]) -> None:
        self._pieces, self._held, self.broken, self.damaged = pieces, bytearray(), False, False

    def _more(self) -> bool:
        if self.damaged:
            return False
        try:
            piece = next(self._pieces)
        except StopIteration as end:
            self.broken |= bool(end.value)
            return False
        if isinstance(piece, Break):
            self.damaged = True
            return False
        self._held += piece
        return True

    @property
    def held(self) -> bool:
        return bool(self._held)

    def resume(self) -> None:
        """Goes on behind a break; what is held from before it is let go."""
        self._held.clear()
        self.damaged = False

    def upto(self, mark: bytes, most: int) -> bytes | None:
        """What comes before the mark, which is skipped; None if it doesn't come within ``most`` bytes."""
        seen = 0
        while (at := self._held.find(mark, seen)) < 0:
            seen = max(0, len(self._held) - len(mark) + 1)
            if seen > most or not self._more():
                return None
        out = bytes(self._held[:at])
        del self._held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in pieces, or fewer if the stream ends or breaks."""
        while n:
            if not self._held and not self._more():
                return
            piece = bytes(self._held[:n])
            del self._held[:n]
            n -= len(piece)
            yield piece

    def skip_blank(self) -> None:
        """Line breaks between records."""
        while True:
            k = 0
            while k < len(self._held) and self._held[k] in b"\r\n":
                k += 1
            del self._held[:k]
            if self._held or not self._more():
                return

    def skip_to_break(self) -> None:
        self._held.clear()
        while self._more():
            self._held.clear()


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(text: str, sign: bool = False) -> int | None:
    """A decimal of ASCII digits that fits in 64 bits."""
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}" if sign else "[0-9]{1,18}", text) else None


def normalise(raw: BinaryIO, out: BinaryIO, level: int = LEVEL) -> Iterator[dict]:
    """Rewrites the records of a gzip stream one member each, and tells where each went.

    Nothing is lost without a row that says so. A record that the stream ends or is damaged in or before gets no place but the status
    "truncated" or "corrupt"; after damage, reading goes on with the next member that can be found. A head without a length, or
    longer than HEAD, is "malformed": where the next record starts can't be told, so that all up to the next break or the end goes
    with it. A stream of no records gives one row, "empty".
    """
    pieces, offset, record, told = Pieces(inflated(raw)), 0, 0, False
    while True:
        pieces.skip_blank()
        head = pieces.upto(b"\r\n\r\n", HEAD)
        fields, length = {}, None
        if head is None:
            if pieces.damaged:
                state = "corrupt"
            elif len(pieces._held) > HEAD:
                state = "malformed"
            elif pieces.held or pieces.broken:
                state = "truncated"
            else:
                if not told:
                    yield {"record": 0, "status": "empty"}
                return
        else:
            fields = headers_of(head)
            length = _number(fields.get("content-length", ""))
            state = "ok" if head.startswith(b"WARC/") and length is not None else "malformed"
        told = True
        known = {"record": record, "url": fields.get("warc-target-uri"), "page_id": _number(fields.get(PAGE_HEADER.lower(), ""), sign=True), "content_length": length}
        written, digest = 0, hashlib.sha1()
        if state == "ok":
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            left = length
            member = [deflate.compress(head + b"\r\n\r\n")]
            for piece in pieces.take(left):
                digest.update(piece)
                left -= len(piece)
                member.append(deflate.compress(piece))
                if sum(map(len, member)) > PIECE:
                    written += out.write(b"".join(member))
                    member = []
            if left:
                # what was written of it lies where no index points
                offset += written
                state = "corrupt" if pieces.damaged else "truncated"
            else:
                member += [deflate.compress(b"\r\n\r\n"), deflate.flush()]
                written += out.write(b"".join(member))
                yield known | {"offset": offset, "length": written, "content_sha1": digest.hexdigest(), "status": "ok"}
                offset += written
                record += 1
                continue
        yield known | {"status": state}
        record += 1
        if state == "malformed":
            pieces.skip_to_break()
        if not pieces.damaged:
            return
        pieces.resume()


def read_record(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and content of the record at ``offset``; only its member is read."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        data = zlib.decompress(f.read_at(length, offset), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers_of(head)
    return fields, rest[: int(fields["content-length"])]


# --- files ---


def _attempt() -> str:
    c = TaskContext.get()
    return f"{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if c else uuid.uuid4().hex[:8]


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url}")
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
    if url is not None:
        head += f"WARC-Target-URI: {' '.join(url.split())}\r\n"
    if page_id is not None:
        head += f"{PAGE_HEADER}: {page_id}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    return head.encode() + http + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, level: int = LEVEL_MONOLITHIC) -> DataFrame:
    """Writes pages as WARC files of one gzip stream each, one file from each partition; a row (file) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        part, n = posixpath.join(inner, f".{name}.{_attempt()}"), 0
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        with system.open_output_stream(part) as out:
            for batch in batches:
                for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                    out.write(deflate.compress(record_bytes(page.as_py(), url.as_py(), html.as_py())))
                    n += 1
            out.write(deflate.flush())
        if n:
            system.move(part, posixpath.join(inner, name))
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)])], ["file"])
        else:
            system.delete_file(part)

    return pages.select("page_id", "url", "html").mapInArrow(run, "file string")


def normalise_files(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Normalises each file named in column ``file`` into ``folder``, where NAME.idx beside it holds its index, and returns the index: {schema}.

    ``file`` is the new file; ``offset`` and ``length`` place the record's member in it. What couldn't be read has a row without an
    offset, whose status says why (:func:`normalise`); each file has a row at least. A null file name is skipped; equal names in different
    folders are kept apart by a hash of the folder; a file that is listed twice is normalised once. Each file is a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for path in batch.column("file").to_pylist():
                source, at = fs.FileSystem.from_uri(path)
                name = f"{hashlib.md5(posixpath.dirname(path).encode()).hexdigest()[:8]}-{posixpath.basename(path)}"
                tag = _attempt()
                new, index = posixpath.join(inner, f".{name}.{tag}"), posixpath.join(inner, f".{name}.idx.{tag}")
                rows: list[dict] = []
                with source.open_input_stream(at, compression=None) as raw, system.open_output_stream(new, compression=None) as out, system.open_output_stream(index, compression=None) as idx:
                    for row in normalise(raw, out, level):
                        if row["status"] == "ok":
                            idx.write(f"{row['offset']}\t{row['length']}\t{'' if row['page_id'] is None else row['page_id']}\t{row['content_sha1']}\t{row['url'] or ''}\n".encode())
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _index(rows, posixpath.join(folder, name))
                            rows = []
                system.move(new, posixpath.join(inner, name))
                system.move(index, posixpath.join(inner, f"{name}.idx"))
                if rows:
                    yield _index(rows, posixpath.join(folder, name))

    names = cut(files.select("file").where("file is not null").distinct())
    # by number, which adaptive execution leaves alone: one partition's names (some MB at most) are dealt out in turn, one to a task
    return names.coalesce(1).repartition(max(1, names.count())).mapInArrow(run, INDEX_SCHEMA)


normalise_files.__doc__ = normalise_files.__doc__.format(schema=INDEX_SCHEMA)


def _index(rows: list[dict], file: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([file if f == "file" else r.get(f) for r in rows], kinds[k]) for f, k in _FIELDS], [f for f, _ in _FIELDS])


def warc_index(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages written as whole-file streams and normalised into FOLDER/records: a row for each page, with (page_id, url, record, offset, length, content_length, content_sha1, file, status).

    Nulls: a null page id or url is left out of the record's head and null in the index; a null html is written as an
    empty one. Long pages are streamed. Repeated rows are records of their own. An empty table gives an empty
    result. Other columns of ``pages`` are not read.
    """
    files = cut(write_monolithic(pages, f"{folder}/monolithic"))
    index = cut(normalise_files(files, f"{folder}/records"))
    remove(spark, f"{folder}/monolithic")
    return index


def op9_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{table_dir(spark)}/warc-{uuid.uuid4().hex}")
