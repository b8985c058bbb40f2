"""WARC archives, index first.

Writing: each task streams its pages into one archive file in the shared folder (a gzip member
per record) and returns an index row per record: file, offset, length, url, digest. The index is
what Spark commits, and a file's name is new with each attempt; so records of an attempt that was
lost or ran twice are never referred to, and nothing is renamed. Reading: the index rows of the
selected records are sorted by (file, offset), neighbouring byte ranges are coalesced, and each
range is read once.

Of pages with equal payloads (SHA-1 and length) the one with the smallest page_id is a response
record, the others are revisit records that refer to it. Which those are is found on digests
alone; pages are joined to that list only if there is one.

Files are reached through pyarrow's file systems, so the shared folder can be local to all
(file:), HDFS or an object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

_RECORD_ID = "urn:tessera:page:"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, unique: str = "") -> bytes:
    """One WARC record; a revisit record, if refers_to is given, has no payload but its digest and length.

    `unique` tells records of one page_id, or of none, apart.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        kind, block = "response", http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        kind, block = "revisit", http + b"\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_RECORD_ID}{'null' if page_id is None else page_id}{unique and ':' + unique}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; ValueError if it is damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Rows (page_id, sha1, n, refers_to) of the pages whose payload, of min_payload bytes at least, an earlier page_id has too."""
    payload = _payload()
    narrow = materialize(pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("n")).where(F.col("n") >= min_payload), "digests")
    groups = narrow.groupBy("sha1", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1")
    return narrow.join(groups, ["sha1", "n"]).where("page_id <> refers_to").select("page_id", "sha1", "n", "refers_to").distinct()


def write(pages: DataFrame, min_payload: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index, itself a table in the shared folder.

    Null html is an empty payload, a null url an empty one. Equal payloads: smallest page_id
    first; rows that share that page_id are all responses, and a null page_id is a response too.
    Extra columns are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    again = materialize(revisits(pages, min_payload), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if again.isEmpty():
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        known = rows.withColumns({"sha1": F.sha1(_payload()), "n": F.length(_payload())})
        rows = known.join(again, ["page_id", "sha1", "n"], "left").select("page_id", "url", "html", "refers_to")
    folder = shared_path(spark, "warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None:
                        fs, path = _files(folder)
                        fs.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        at = 0
                    payload = (row["html"] or "").encode("utf-8")
                    data = gzip.compress(record(row["page_id"], row["url"], payload, row["refers_to"], date, f"{name[:32]}-{at}"), level, mtime=0)
                    out.write(data)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    index.append((row["page_id"], f"{folder}/{name}", at, len(data), row["url"], payload_digest(payload), kind))
                    at += len(data)
                if index:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    names = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(store, INDEX), "warc-index")


def read(selected: DataFrame, gap: int = 1 << 16, most: int = 1 << 22, task_bytes: int = 1 << 25) -> DataFrame:
    """Read the records of the given index rows: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, html).

    Ranges less than `gap` bytes apart are read together, up to `most` bytes at a time; a task reads
    about `task_bytes`. url is the index's, as its header can't hold control characters. An empty
    selection gives an empty result, an index row that is selected twice two rows. A revisit
    record has no html; its payload_bytes and payload_digest are those its headers state for the
    full payload. For responses they are computed from the bytes that were read.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]

    def number(field: str | None) -> int | None:
        text = (field or "").strip("<>").removeprefix(_RECORD_ID).partition(":")[0]
        return int(text) if text not in ("", "null") else None

    def one(data: bytes, url: str | None) -> tuple:
        fields, payload = parse(gzip.decompress(data))
        kind = fields["warc-type"]
        if kind == "revisit":
            size, digest, html = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
        else:
            size, digest, html = len(payload), payload_digest(payload), payload.decode("utf-8")
            if f"sha1:{digest}" != fields["warc-payload-digest"]:
                raise ValueError("a payload that differs from its digest")
        return number(fields["warc-record-id"]), url, kind, number(fields.get("warc-refers-to")), size, digest, html

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                file, begin = rows[k]["file"], rows[k]["offset"]
                end, j = begin, k
                while (
                    j < len(rows)
                    and rows[j]["file"] == file
                    and rows[j]["offset"] - end <= gap
                    and (j == k or rows[j]["offset"] + rows[j]["length"] - begin <= most)
                ):
                    end = max(end, rows[j]["offset"] + rows[j]["length"])
                    j += 1
                if file != opened:
                    if handle is not None:
                        handle.close()
                    fs, path = _files(file)
                    opened, handle = file, fs.open_input_file(path)
                data = handle.read_at(end - begin, begin)
                got = [one(data[r["offset"] - begin : r["offset"] - begin + r["length"]], r["url"]) for r in rows[k:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
                k = j
        if handle is not None:
            handle.close()

    rows = selected.select("file", "offset", "length", "url")
    total = rows.agg(F.sum("length")).first()[0] or 0
    # of the records' bytes, not the index's
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    ranges = rows.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(fetch, schema)
