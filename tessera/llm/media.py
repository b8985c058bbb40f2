"""Media columns in ISO base media containers.

A writer stores a payload losslessly as 8-bit samples in a container (`ftyp`, `moov`, `mdat`), and
a reader walks the nested boxes, decodes the sample tables (sizes, chunk offsets, samples per
chunk, durations, sync samples) and reports codec, duration and the byte range of each keyframe.
The reader never looks inside `mdat`; payload bytes are fetched by the ranges it reports.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 576
#: A sync sample begins every so many samples.
KEY_EVERY = 8
PER_CHUNK = 16
RATE = 48_000
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"})


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write(payload: bytes) -> bytes:
    """A container with the payload, a positive multiple of SAMPLE bytes, as 8-bit mono samples."""
    n, rest = divmod(len(payload), SAMPLE)
    if not n or rest:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE} bytes")
    chunks = -(-n // PER_CHUNK)
    per_chunk = [(1, PER_CHUNK if n >= PER_CHUNK else n, 1)]
    if n > PER_CHUNK and n % PER_CHUNK:
        per_chunk.append((chunks, n % PER_CHUNK, 1))
    sync = range(1, n + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")
    long_offsets = len(payload) > 0xF0000000

    def moov(base: int) -> bytes:
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        offsets = [base + k * PER_CHUNK * SAMPLE for k in range(chunks)]
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            _full(b"stsc", struct.pack(">I", len(per_chunk)), *(struct.pack(">III", *x) for x in per_chunk)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets))
            if long_offsets
            else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets)),
        )
        dref = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", dref), tables)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n * SAMPLE, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * SAMPLE), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _UNITY, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n * SAMPLE, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0))
    large = len(payload) + 8 > 0xFFFFFFFF
    lead = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((ftyp, moov(head + len(lead)), lead, payload))


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin of body, end) of each box between start and end; a size that doesn't fit raises ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, body, start + size
        start += size


def _walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...], found: dict) -> None:
    """The first box of each path between start and end."""
    for kind, body, stop in boxes(data, start, end):
        found.setdefault((*path, kind), (body, stop))
        if kind in NESTED:
            _walk(data, body, stop, (*path, kind), found)


@dataclass
class Track:
    kind: str
    codec: str
    timescale: int
    duration: int
    sizes: list[int]
    offsets: list[int]
    sync: list[int]

    @property
    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of each sync sample."""
        return [(self.offsets[s - 1], self.sizes[s - 1]) for s in self.sync]


def tracks(data: bytes) -> list[Track]:
    """Each track's codec, duration and samples from the boxes, without touching the payload; ValueError if the container is damaged."""
    view = memoryview(data)
    try:
        return [
            _track(view, start, end)
            for kind, body, stop in boxes(view)
            if kind == b"moov"
            for inner, start, end in boxes(view, body, stop)
            if inner == b"trak"
        ]
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"a damaged container: {e!r}") from e


def read(data: bytes) -> Track:
    """The first video track, or the first track if there is none."""
    found = tracks(data)
    if not found:
        raise ValueError("no track")
    return next((t for t in found if t.kind == "vide"), found[0])


def _track(view: memoryview, start: int, end: int) -> Track:
    found: dict[tuple[bytes, ...], tuple[int, int]] = {}
    _walk(view, start, end, (), found)
    mdia = (b"mdia",)
    stbl = (*mdia, b"minf", b"stbl")

    def at(*path: bytes) -> tuple[int, int]:
        return found[path]

    body, _ = at(*mdia, b"hdlr")
    handler = bytes(view[body + 8 : body + 12]).decode("latin-1")
    body, _ = at(*mdia, b"mdhd")
    timescale, duration = struct.unpack_from(">IQ", view, body + 20) if view[body] == 1 else struct.unpack_from(">II", view, body + 12)
    body, _ = at(*stbl, b"stsd")
    codec = bytes(view[body + 12 : body + 16]).decode("latin-1")
    body, _ = at(*stbl, b"stsz")
    each, n = struct.unpack_from(">II", view, body + 4)
    sizes = [each] * n if each else list(struct.unpack_from(f">{n}I", view, body + 12))
    body, _ = at(*stbl, b"co64" if (*stbl, b"co64") in found else b"stco")
    wide = "Q" if (*stbl, b"co64") in found else "I"
    (chunks,) = struct.unpack_from(">I", view, body + 4)
    starts = struct.unpack_from(f">{chunks}{wide}", view, body + 8)
    body, _ = at(*stbl, b"stsc")
    (runs,) = struct.unpack_from(">I", view, body + 4)
    table = [struct.unpack_from(">III", view, body + 8 + 12 * k) for k in range(runs)]
    offsets: list[int] = []
    for k, (first, per, _) in enumerate(table):
        last = table[k + 1][0] if k + 1 < runs else chunks + 1
        for c in range(first, last):
            place = starts[c - 1]
            for _ in range(per):
                offsets.append(place)
                place += sizes[len(offsets) - 1]
    if (*stbl, b"stss") in found:
        body, _ = at(*stbl, b"stss")
        (m,) = struct.unpack_from(">I", view, body + 4)
        sync = list(struct.unpack_from(f">{m}I", view, body + 8))
    else:
        sync = list(range(1, n + 1))
    if len(offsets) != n or any(not 1 <= s <= n for s in sync):
        raise ValueError("sample tables that contradict each other")
    return Track(handler, codec, timescale, duration, sizes, offsets, sync)


def _map(df: DataFrame, column: str, kind: str, make, names: list[str], types: list[pa.DataType], out: str) -> DataFrame:
    """df without `column`, and the columns that make() gives for its values."""
    kept = [c for c in df.columns if c != column and c not in names]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time, as a value can be large
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = [make(v.as_py()) for v in part.column(len(kept))]
                cols = [pa.array([g[k] for g in got], type=t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + cols, names=[*kept, *names])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(column).cast(kind).alias(column)).mapInArrow(run, schema)


def wrap(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with n_bytes and media: the text's UTF-8 bytes, padded by bytes 255 to a positive multiple of 576, in a container.

    Null text counts as empty (one sample of padding). Columns named n_bytes and media are replaced.
    """

    def make(value: str | None) -> tuple[int, bytes]:
        raw = (value or "").encode("utf-8")
        return len(raw), write(raw + b"\xff" * (max(1, -(-len(raw) // SAMPLE)) * SAMPLE - len(raw)))

    return _map(docs, text, "string", make, ["n_bytes", "media"], [pa.int64(), pa.binary()], "n_bytes long, media binary")


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """media without `column`, with codec, duration_s, keyframes (offset, length) and digests of what the boxes point at.

    They are of the first video track, or of the first track. payload_bytes, payload_sha256 and
    tail_crc32 (its last 32 bytes) come from the samples that the tables locate; media_bytes and
    media_sha256 from the stored form. A damaged container is a row whose `error` says so, with
    nulls but for those two; null media is a row of nulls. Columns of these names are replaced.
    """
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))

    def make(value: bytes | None) -> tuple:
        if value is None:
            return (None,) * 9
        try:
            return probed(value)
        except ValueError as e:
            return (None,) * 6 + (len(value), hashlib.sha256(value).hexdigest(), str(e))

    def probed(value: bytes) -> tuple:
        track, view = read(value), memoryview(value)
        if any(o + s > len(value) for o, s in zip(track.offsets, track.sizes, strict=True)):
            raise ValueError("samples beyond the end")
        digest, tail, total, k, n = hashlib.sha256(), b"", 0, 0, len(track.sizes)
        while k < n:  # samples that follow each other are read at once
            begin = end = track.offsets[k]
            while k < n and track.offsets[k] == end:
                end += track.sizes[k]
                k += 1
            digest.update(view[begin:end])
            total += end - begin
            tail = (tail + bytes(view[max(begin, end - 32) : end]))[-32:]
        keys = [{"offset": o, "length": s} for o, s in track.keyframes]
        return (
            track.codec, track.duration / max(1, track.timescale), keys, total, digest.hexdigest(), zlib.crc32(tail), len(value), hashlib.sha256(value).hexdigest(), None,
        )

    names = ["codec", "duration_s", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
    types = [pa.string(), pa.float64(), ranges, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    out = (
        "codec string, duration_s double, keyframes array<struct<offset:bigint,length:bigint>>, payload_bytes long, "
        "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"
    )
    return _map(media, column, "binary", make, names, types, out)
