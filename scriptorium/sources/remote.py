"""Driver-side helpers around remote stores: listings page by page, downloads that appear only when complete, and streams that are landed before Spark reads them. How bytes are fetched is the caller's."""

from __future__ import annotations

import json
import random
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any, BinaryIO, TypeVar
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import check_source

X = TypeVar("X")
LISTING = "key string, size bigint, modified string"


class Unavailable(Exception):
    """A failure that may pass: too many requests, a server's error, a broken connection."""


def retried(f: Callable[[], X], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> X:
    """The value of ``f``, called again after :class:`Unavailable` or a broken connection, with waits that double, give or take a half."""
    for k in range(tries):
        try:
            return f()
        except (Unavailable, ConnectionError, TimeoutError):
            if k == tries - 1:
                raise
        sleep(wait * 2**k * (0.5 + random.random()))
    raise ValueError("tries: 1 at least")


def parse_listing(page: str) -> tuple[list[tuple[str, int, str]], str | None]:
    """(key, size, modified) of the objects of one page in the common XML form, and the token of the next page; None if it is the last."""
    root = ET.fromstring(page)
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]
    rows = [(x.findtext("Key", ""), int(x.findtext("Size") or 0), x.findtext("LastModified", "")) for x in root.iter("Contents")]
    more = (root.findtext("IsTruncated") or "").lower() == "true"
    token = root.findtext("NextContinuationToken") or root.findtext("NextMarker") or (rows[-1][0] if rows else None)
    return rows, token if more else None


def list_objects(fetch: Callable[[str | None], str], **retry: Any) -> Iterator[tuple[str, int, str]]:
    """All objects of a listing; ``fetch`` gives the page of a token, the first for None. A token that comes again is an error, not a loop."""
    token, seen = None, set()
    while True:
        rows, following = parse_listing(retried(lambda: fetch(token), **retry))  # noqa: B023
        yield from rows
        if following is None:
            return
        if following in seen:
            raise ValueError(f"the listing goes round at {following}")
        seen.add(following)
        token = following


def listing(spark: SparkSession, fetch: Callable[[str | None], str], **retry: Any) -> DataFrame:
    return spark.createDataFrame(list(list_objects(fetch, **retry)), LISTING)


def download(opener: Callable[[], BinaryIO], path: str, piece: int = 1 << 20, **retry: Any) -> bool:
    """Copies a stream to ``path``, under another name until it is whole; False if it was there already."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return False

    def copy() -> None:
        part = f"{at}.{uuid4().hex[:8]}.part"
        try:
            with opener() as raw, system.open_output_stream(part, compression=None) as out:
                while data := raw.read(piece):
                    out.write(data)
            system.move(part, at)
        except BaseException:
            if system.get_file_info(part).type == fs.FileType.File:
                system.delete_file(part)
            raise

    retried(copy, **retry)
    return True


def land_stream(spark: SparkSession, opener: Callable[[str], Iterable[dict]], revision: str, path: str, schema: T.StructType, cap: int | None = None, **retry: Any) -> DataFrame:
    """Rows of a hub's stream at a pinned revision, landed as JSON lines at ``path`` and read from there; a stream that breaks is begun again."""
    check_source("hub", revision, streaming=True)
    system, at = fs.FileSystem.from_uri(path)

    def copy() -> None:
        part = f"{at}.{uuid4().hex[:8]}.part"
        try:
            with system.open_output_stream(part, compression=None) as out:
                for row in islice(opener(revision), cap):
                    out.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
            system.move(part, at)
        except BaseException:
            if system.get_file_info(part).type == fs.FileType.File:
                system.delete_file(part)
            raise

    if system.get_file_info(at).type != fs.FileType.File:
        retried(copy, **retry)
    return spark.read.schema(schema).json(path)
