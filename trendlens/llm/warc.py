"""WARC archives of pages, an index, and ranged reads of selected records.

Write: every task writes its rows as records of an archive of its own
(``response``, or ``revisit`` for a payload that another record holds), each a
gzip member, and returns for each an index row: archive, offset, length, URL, payload
digest and size.  The index is a Parquet table, committed by Spark; archives are
named anew by every attempt of a task, so what a lost executor has left behind
is in no index row and never read.

Which record of equal payloads is the response is settled before: digests are
counted (partial aggregates), and the groups of two or more, a narrow table
written once, are joined to the pages by digest; Spark broadcasts them where
their written size allows, else a hot digest's rows are split by adaptive
execution.

Read: index rows, after any selection, are sorted by archive and offset; a task
joins neighbouring ranges into reads of at most ``READ_BYTES`` across gaps of at
most ``GAP_BYTES``, and takes the records out of them.  A payload that does not
have its record's digest is an error.

Archives lie in a shared folder and are reached through ``pyarrow.fs`` (files,
HDFS, S3, GCS).

Defined results: a null payload is empty.  Equal payloads of ``least`` bytes or
more have one response, that of the largest page_id (null ids come last), to
which the others refer; rows that repeat the id and payload of a response are
responses too; shorter payloads are all responses.  A record holds one payload and is written at once: the
longest payload bounds a task's memory.  A null URL gives a record without
target; control characters and blanks in a URL are percent-encoded in the record
(the index keeps them).  Empty tables give no archive and empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm._common import table, text_of
from trendlens.session import scratch_path
from trendlens.sources.writers import materialize

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
LEVEL = 6
#: Records carry one date, so that archives are the same in every run.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id long, url string, record_type string, refers_to long, archive string, `offset` long, length long, "
    "payload_digest string, payload_bytes long"
)
RECORDS = "page_id long, url string, record_type string, refers_to long, payload string, payload_bytes long, payload_digest string"
_END = b"\r\n\r\n"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, revisit: bool) -> bytes:
    """One record; ``digest`` is the payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http if revisit else http + payload
    header = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        header.append(f"WARC-Target-URI: {_target(url)}")
    header.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_uri(response)}"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(header).encode() + _END + block + _END


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix("urn:page:")
    return None if name == "null" else int(name)


def parse(data: bytes) -> dict:
    """The fields of one record; a response's payload must have its digest."""
    head, rest = data.split(_END, 1)
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != _END:
        raise ValueError("a record does not end where its header says")
    http, payload = block.split(_END, 1)
    size = int(_headers(http)["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
    }


def with_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``page_id, url, payload, payload_digest`` and ``response``, the page_id
    that holds an equal payload, where there are several."""
    payload = text_of(payload_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("payload_digest")
    )
    large = rows.where(F.octet_length("payload") >= least).select("page_id", "payload_digest")
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(F.col("payload_digest").alias("of"), "response")
    return rows.join(materialize(groups, "equal-payloads"), F.col("payload_digest") == F.col("of"), "left").select(
        *rows.columns, F.col("of").isNotNull().alias("repeated"), "response"
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_REVISIT,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record for each row below ``folder`` and returns the index, read
    from its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                made = []
                for k in range(batch.num_rows):  # one payload at a time
                    row = {c: batch[c][k].as_py() for c in batch.schema.names}
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = row["payload"].encode()
                    revisit = row["repeated"] and row["page_id"] != row["response"]
                    member = gzip.compress(
                        record(row["page_id"], row["url"], payload, row["payload_digest"], row["response"], revisit), LEVEL, mtime=0
                    )
                    out.write(member)
                    refers_to = row["response"] if revisit else None
                    kind = "revisit" if revisit else "response"
                    made.append((row["page_id"], row["url"], kind, refers_to, name, at, len(member), row["payload_digest"], len(payload)))
                    at += len(member)
                yield _batch(made, INDEX)
        finally:
            if out is not None:
                out.close()

    return materialize(with_responses(pages, id_col, url_col, payload_col, least).mapInArrow(run, INDEX), "warc-index")


_TYPES = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip("` ").split(" ") for f in schema.replace("`", "").split(", ")]
    columns = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def coalesced(ranges: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[list[int]]:
    """Numbers of sorted (archive, offset, length) that are read at once."""
    group: list[int] = []
    for k, (archive, offset, length) in enumerate(ranges):
        if group:
            first, last = ranges[group[0]], ranges[group[-1]]
            near = archive == first[0] and offset - (last[1] + last[2]) <= gap_bytes and offset + length - first[1] <= read_bytes
            if not near:
                yield group
                group = []
        group.append(k)
    if group:
        yield group


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the rows of ``index`` (all, or those selected): page_id,
    url, record_type, refers_to, payload (null for revisits), payload_bytes and
    payload_digest, read from the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, source = None, None
        try:
            for batch in batches:
                ranges = list(zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True))
                urls = batch["url"].to_pylist()
                for group in coalesced(ranges):
                    archive, first, _ = ranges[group[0]]
                    if archive != name:
                        if source is not None:
                            source.close()
                        name, source = archive, store.open_input_file(f"{root}/{archive}")
                    last = ranges[group[-1]]
                    data = memoryview(source.read_at(last[1] + last[2] - first, first))
                    made = []
                    for k in group:
                        _, offset, length = ranges[k]
                        r = parse(zlib.decompress(data[offset - first : offset - first + length], wbits=31))
                        payload = None if r["payload"] is None else r["payload"].decode()
                        made.append((r["page_id"], urls[k], r["record_type"], r["refers_to"], payload, r["payload_bytes"], r["payload_digest"]))
                    yield _batch(made, RECORDS)
        finally:
            if source is not None:
                source.close()

    chosen = index.select("url", "archive", "offset", "length")
    ordered = chosen.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, RECORDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM m
"""
