"""Tables behind byte ranges, such as files on a web server (A4).

A fetcher knows a file's size and gives any of its byte ranges; everything else
is Spark's work.  A CSV file is cut into ranges, one task each.  A range owns
the lines that begin in it: its task skips the line that runs into it and reads
on past its end until its last line is complete, so every line is read once,
wherever the cuts fall.  Tasks fetch a few megabytes at a time and hold one such
block and one unfinished line.  A Parquet file has one task for each row group.

A lost task fetches its range again.  The version that the driver saw (ETag,
time of change) is sent along, so a file that changes meanwhile fails the read
instead of mixing two states.

Lines end in ``\\n`` or ``\\r\\n``.  As in a file read without ``multiline``, cells
hold no line breaks, and blank lines are no rows.  An empty file has no rows.
"""

from __future__ import annotations

import csv
import io
import random
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from http.client import HTTPException
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from trendlens.functions.nulls import PANDAS_NA_TOKENS
from trendlens.sources.readers import cast_text, infer_types, normalise_nulls

# Fetchers and readers travel to the tasks by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
#: What is fetched first past the end of a range, to finish its last line.
TAIL_BYTES = 64 << 10
CORRUPT = "_corrupt_line"


class Fetcher(Protocol):
    """Where the bytes come from.  Instances are pickled into the tasks."""

    def stat(self, url: str) -> tuple[int, str]:
        """Size in bytes and a version that changes with the contents."""

    def fetch(self, url: str, start: int, end: int, version: str) -> bytes:
        """Bytes ``start`` to ``end`` (exclusive); an error if the version is another."""


class Changed(IOError):
    """The file is not the one whose size was asked for."""


@dataclass(frozen=True)
class FileFetcher:
    """Ranges of a file in shared storage, by path or URI."""

    def _open(self, url: str):
        return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)

    def stat(self, url: str) -> tuple[int, str]:
        store, path = self._open(url)
        info = store.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(url)
        return info.size, f"{info.size} {info.mtime_ns}"

    def fetch(self, url: str, start: int, end: int, version: str) -> bytes:
        if self.stat(url)[1] != version:
            raise Changed(url)
        store, path = self._open(url)
        with store.open_input_file(path) as f:
            return f.read_at(end - start, start)


@dataclass(frozen=True)
class HttpFetcher:
    """Ranges of a file on a web server, which must answer range requests.

    Failures that may pass (no connection, a broken answer, 429, 5xx) are tried
    ``tries`` times with growing pauses; all others are raised at once.
    """

    headers: Mapping[str, str] = field(default_factory=dict, repr=False)
    timeout: float = 60.0
    tries: int = 5
    pause: float = 0.5

    def _get(self, url: str, start: int, end: int, version: str = ""):
        """Status, headers and body of one range request."""
        asked = {**self.headers, "Range": f"bytes={start}-{end - 1}", "Accept-Encoding": "identity"}
        if version.startswith('"'):  # a strong tag; a weak one is no condition for a range
            asked["If-Range"] = version
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=asked), timeout=self.timeout) as r:
                    # without range support the whole file would follow: it is not read
                    body = r.read() if r.status == 206 else b""
                    if r.status == 206 and len(body) < int(r.headers.get("Content-Length", len(body))):
                        raise HTTPException("the answer ended early")
                    return r.status, r.headers, body
            except urllib.error.HTTPError as e:
                if e.code == 416:  # nothing there: an empty file
                    return e.code, e.headers, b""
                if not left or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, HTTPException, TimeoutError, ConnectionError):
                if not left:
                    raise
            time.sleep(self.pause * 2 ** (self.tries - 1 - left) * (1 + random.random()))
        raise ValueError("tries must be positive")

    @staticmethod
    def _version(headers) -> str:
        return headers.get("ETag") or headers.get("Last-Modified") or ""

    def stat(self, url: str) -> tuple[int, str]:
        status, headers, _ = self._get(url, 0, 1)
        total = (headers.get("Content-Range") or "").rpartition("/")[2]
        if status not in (206, 416) or not total.isdigit():
            raise ValueError(f"{url} has no byte ranges: copy the file to shared storage first")
        return int(total), self._version(headers)

    def fetch(self, url: str, start: int, end: int, version: str) -> bytes:
        status, headers, body = self._get(url, start, end, version)
        if status != 206 or self._version(headers) != version:
            raise Changed(url)
        if not (headers.get("Content-Range") or "").startswith(f"bytes {start}-{end - 1}/") or len(body) != end - start:
            raise IOError(f"{url}: another range than {start}-{end - 1} came back")
        return body


def owned_lines(fetch, size: int, start: int, end: int, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The lines that begin in ``[start, end)`` of a file of ``size`` bytes, in
    order, without their line feeds.  ``fetch(a, b)`` gives bytes ``a`` to ``b``."""
    at, skipping = max(start - 1, 0), start > 0
    open_line: list[bytes] = []  # pieces of a line whose end is still to come
    tail = min(block, TAIL_BYTES)
    while at < size:
        if at < end:
            stop = min(at + block, end, size)
        elif skipping or not open_line:
            return  # no line of this range is left
        else:
            stop, tail = min(at + tail, size), min(2 * tail, block)
        data, at = fetch(at, stop), stop
        if skipping:
            _, feed, data = data.partition(b"\n")
            if not feed:
                continue
            skipping = False
        first, *more = data.split(b"\n")
        if not more:
            open_line += [first] if first else []
            continue
        lines = [b"".join([*open_line, first]), *more[:-1]]
        open_line = [more[-1]] if more[-1] else []
        if stop > end:  # the last line is complete; what follows is another range's
            yield lines[:1]
            return
        yield lines
    if open_line:
        yield [b"".join(open_line)]


@dataclass
class Span(InputPartition):
    url: str
    version: str
    size: int
    start: int
    end: int


class LineReader(DataSourceReader):
    def __init__(self, fetcher: Fetcher, spans: list[Span], block: int):
        self.fetcher, self.spans, self.block = fetcher, spans, block

    def partitions(self):
        return self.spans

    def read(self, span: Span | None):
        if span is None:  # Spark's one task for no partitions
            return

        def fetch(a: int, b: int) -> bytes:
            return self.fetcher.fetch(span.url, a, b, span.version)

        for lines in owned_lines(fetch, span.size, span.start, span.end, self.block):
            texts = [line.decode("utf-8", "replace").removesuffix("\r") for line in lines]
            yield pa.RecordBatch.from_pydict({"line": pa.array([t for t in texts if t.strip()], pa.string())})


class GroupReader(DataSourceReader):
    """``start`` of a span is the number of its row group."""

    def __init__(self, fetcher: Fetcher, spans: list[Span], columns: list[str], rows: int):
        self.fetcher, self.spans, self.columns, self.rows = fetcher, spans, columns, rows

    def partitions(self):
        return self.spans

    def read(self, span: Span | None):
        if span is None:
            return
        file = parquet_file(self.fetcher, span.url, span.size, span.version)
        for batch in file.iter_batches(self.rows, row_groups=[span.start], columns=self.columns):
            yield batch.select(self.columns)


class RangeFile(io.RawIOBase):
    """A file to seek in, whose reads are range requests."""

    def __init__(self, fetcher: Fetcher, url: str, size: int, version: str):
        self.of, self.size, self.at = (fetcher, url, version), size, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=io.SEEK_SET):
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, into):
        stop = min(self.at + len(into), self.size)
        if stop <= self.at:
            return 0
        fetcher, url, version = self.of
        data = fetcher.fetch(url, self.at, stop, version)
        into[: len(data)] = data
        self.at = stop
        return len(data)


def parquet_file(fetcher: Fetcher, url: str, size: int, version: str) -> pq.ParquetFile:
    return pq.ParquetFile(pa.PythonFile(io.BufferedReader(RangeFile(fetcher, url, size, version), 1 << 20), mode="r"))


def _load(spark: SparkSession, reader: DataSourceReader, schema: T.StructType) -> DataFrame:
    """A frame of what ``reader`` reads.  The reader belongs to a class made for
    this frame, so nothing of it (headers, say) shows among the plan's options."""

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return "trendlens_remote"

        def schema(self):
            return schema

        def reader(self, schema):
            return reader

    spark.dataSource.register(Remote)
    return spark.read.format(Remote.name()).load()


def cut(first: int, size: int, split_bytes: int) -> list[tuple[int, int]]:
    """Ranges of about equal size over bytes ``first`` to ``size``."""
    if split_bytes < 1:
        raise ValueError("split_bytes must be positive")
    n = -(-(size - first) // split_bytes) if size > first else 0
    edges = [first + (size - first) * i // n for i in range(n + 1)] if n else []
    return list(zip(edges, edges[1:]))


def _header(fetcher: Fetcher, url: str, size: int, version: str) -> tuple[list[str], int]:
    """Column names of a CSV file and where its rows begin."""
    at = 0
    for lines in owned_lines(lambda a, b: fetcher.fetch(url, a, b, version), size, 0, size, TAIL_BYTES):
        for line in lines:
            at += len(line) + 1
            text = line.decode("utf-8", "replace").removeprefix("\ufeff").strip()
            if text:
                return next(csv.reader([text])), min(at, size)
    return [], size


def read_remote_csv(
    spark: SparkSession,
    url: str | list[str],
    schema: T.StructType | str | None = None,
    fetcher: Fetcher | None = None,
    split_bytes: int = SPLIT_BYTES,
    null_tokens: Iterable[str] | None = ("",),
    pandas_na: bool = False,
    mode: str = "FAILFAST",
    corrupt_column: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """CSV files with a header row, read by ranges; arguments as in
    :func:`readers.read_csv`.  The driver reads the headers only.  Without a
    schema the names are those of the first header, which all must share, and
    types are the first of ``readers.INFERRED_TYPES`` that fit (one more read)."""
    fetcher = fetcher or HttpFetcher()
    spans, headers = [], []
    for u in [url] if isinstance(url, str) else url:
        size, version = fetcher.stat(u)
        names, first = _header(fetcher, u, size, version)
        headers.append(names)
        spans += [Span(u, version, size, a, b) for a, b in cut(first, size, split_bytes)]
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if declared is None:
        if any(h != headers[0] for h in headers):
            raise ValueError("the files have different headers")
        if not headers[0]:
            raise ValueError("without a schema the file needs a header")
        declared_names = headers[0]
    else:
        declared_names = [f.name for f in declared.fields if f.name != corrupt_column]

    mode, keep = mode.upper(), corrupt_column or CORRUPT
    cells = T.StructType([T.StructField(n, T.StringType()) for n in declared_names])
    options = {"escape": '"', "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE"}
    if mode != "FAILFAST":
        cells = T.StructType([*cells.fields, T.StructField(keep, T.StringType())])
        options["columnNameOfCorruptRecord"] = keep
    lines = _load(spark, LineReader(fetcher, spans, block_bytes), T.StructType([T.StructField("line", T.StringType())]))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in cells.fields)
    table = lines.select(F.from_csv("line", F.lit(ddl), options).alias("row")).select("row.*")
    if mode == "DROPMALFORMED":
        table = table.where(F.col(keep).isNull())
    if mode != "FAILFAST" and not (corrupt_column and mode == "PERMISSIVE"):
        table = table.drop(keep)
    tokens = list(PANDAS_NA_TOKENS) if pandas_na else list(null_tokens or ())
    table = normalise_nulls(table, tokens, declared_names)
    if declared is None:
        return infer_types(table)
    fields = [f for f in declared.fields if f.name in table.columns]
    if corrupt_column in table.columns and corrupt_column not in declared.names:
        fields.append(T.StructField(corrupt_column, T.StringType()))
    return cast_text(table, T.StructType(fields), mode, corrupt_column)


def read_remote_parquet(
    spark: SparkSession,
    url: str | list[str],
    columns: Iterable[str] | None = None,
    fetcher: Fetcher | None = None,
    batch_rows: int = 10_000,
) -> DataFrame:
    """Parquet files, a task for each row group; only the chunks of ``columns``
    are fetched.  The driver reads the footers only.  All files have the first
    one's columns and types."""
    fetcher = fetcher or HttpFetcher()
    spans, schema = [], None
    for u in [url] if isinstance(url, str) else url:
        size, version = fetcher.stat(u)
        file = parquet_file(fetcher, u, size, version)
        names = list(columns) if columns is not None else file.schema_arrow.names
        missing = [n for n in names if n not in file.schema_arrow.names]
        if missing:
            raise ValueError(f"{u} has no columns {missing}")
        found = from_arrow_schema(pa.schema([file.schema_arrow.field(n) for n in names]), prefer_timestamp_ntz=True)
        if schema is not None and found != schema:
            raise ValueError(f"{u} has other columns or types than the first file")
        schema = found
        spans += [Span(u, version, size, g, g + 1) for g in range(file.num_row_groups)]
    return _load(spark, GroupReader(fetcher, spans, schema.names, batch_rows), schema)
