"""Ogg media columns: payloads stored as 8-bit samples in multiplexed Ogg streams and read back.

Writing: a payload is cut into frames; the frames alternate between logical streams, one packet per
`PACKET_FRAMES` frames; pages hold lacing values of 255 and less, packets run on over pages, and
every page carries its checksum and the granule position (samples finished in its stream).
Reading: page checksums are verified, packets are reassembled from the lacing values, the logical
streams are separated by serial number, timestamps are derived from granule positions, and the
frames are interleaved again. Both work row by row inside Arrow batches; there is no shuffle.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

FRAME = 192  # samples, of one byte each
PACKET_FRAMES = 8
STREAMS = 2
RATE = 8000  # samples a second
PAGE_SEGMENTS = 96  # lacing values a page, at most 255
MAGIC = b"\x7fPCM8\x00\x01\x00"
HEAD = struct.Struct("<8sIHBBQ")  # magic, rate, samples a frame, stream, streams, samples in this stream
PAGE = struct.Struct("<4sBBqIIIB")  # OggS, version, flags, granule, serial, sequence, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_checksum(data: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, not reflected, initial and final value 0.

    It is the bit mirror of the reflected CRC that zlib computes over bit-mirrored bytes.
    """
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets: (bytes, granule position at their end)."""
    segments: list[tuple[bytes, int | None]] = []  # data, granule if a packet ends here
    cuts = []
    for n, (data, granule) in enumerate(packets):
        whole = len(data) // 255
        segments += [(data[i * 255 : i * 255 + 255], None) for i in range(whole)]
        segments.append((data[whole * 255 :], granule))
        if n == 0:
            cuts.append(len(segments))  # the header has a page of its own
    bounds = [0, *cuts, *range(cuts[0] + PAGE_SEGMENTS, len(segments), PAGE_SEGMENTS), len(segments)]
    bounds = sorted(set(bounds))
    pages = []
    for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = segments[a:b]
        ends = [g for _, g in part if g is not None]
        flags = (CONTINUED if a and segments[a - 1][1] is None else 0) | (FIRST if a == 0 else 0) | (LAST if b == len(segments) else 0)
        body = b"".join(s for s, _ in part)
        lacing = bytes(len(s) for s, _ in part)
        head = lambda crc: PAGE.pack(b"OggS", 0, flags, ends[-1] if ends else NO_GRANULE, serial, n, crc, len(part))  # noqa: B023, E731
        pages.append(head(ogg_checksum(head(0) + lacing + body)) + lacing + body)
    return pages


def write_ogg(payload: bytes, streams: int = STREAMS) -> bytes:
    """The payload (a positive multiple of FRAME bytes) as `streams` multiplexed logical streams."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    logical = []
    for s in range(streams):
        own = frames[s::streams]
        packets = [(HEAD.pack(MAGIC, RATE, FRAME, s, streams, len(own) * FRAME), 0)]
        done = 0
        for i in range(0, len(own), PACKET_FRAMES):
            data = b"".join(own[i : i + PACKET_FRAMES])
            done += len(data)
            packets.append((data, done))
        logical.append(_pages(s + 1, packets))
    out = [pages.pop(0) for pages in logical]  # all first pages stand before any other
    while any(logical):
        out += [pages.pop(0) for pages in logical if pages]
    return b"".join(out)


def read_ogg(media: bytes) -> tuple[bytes, dict]:
    """Payload and facts of a stored file; raises ValueError on any damage."""
    at, n_pages = 0, 0
    open_parts: dict[int, list[bytes]] = {}
    packets: dict[int, list[bytes]] = {}
    granule: dict[int, int] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    while at < len(media):
        try:
            magic, version, flags, position, serial, sequence, crc, count = PAGE.unpack_from(media, at)
        except struct.error as e:
            raise ValueError("cut page header") from e
        body = at + PAGE.size + count
        lacing = media[at + PAGE.size : body]
        end = body + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < count or end > len(media):
            raise ValueError("not a page")
        if ogg_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum differs")
        if bool(flags & FIRST) == (serial in packets) or expected.get(serial, 0) != sequence or serial in ended:
            raise ValueError("pages out of order")
        expected[serial] = sequence + 1
        done, parts = packets.setdefault(serial, []), open_parts.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(parts):
            raise ValueError("continued packet without its start, or the reverse")
        for size in lacing:
            parts.append(media[body : body + size])
            body += size
            if size < 255:
                done.append(b"".join(parts))
                parts.clear()
        if position != NO_GRANULE:
            if position < granule.get(serial, 0):
                raise ValueError("granule positions go back")
            granule[serial] = position
        if flags & LAST:
            ended.add(serial)
        at, n_pages = end, n_pages + 1
    if not packets or ended != set(packets) or any(open_parts.values()):
        raise ValueError("cut stream")
    by_stream = {}
    for serial, own in packets.items():
        try:
            magic, rate, frame, s, streams, samples = HEAD.unpack(own[0])
        except struct.error as e:
            raise ValueError("no stream header") from e
        data = b"".join(own[1:])
        if magic != MAGIC or len(data) != samples or granule[serial] != samples:
            raise ValueError("samples and granule position differ")
        by_stream[s] = [data[i : i + frame] for i in range(0, samples, frame)]
    frames: list[bytes] = [b""] * sum(map(len, by_stream.values()))
    for s, own in by_stream.items():
        frames[s :: len(by_stream)] = own
    facts = {
        "streams": len(packets), "pages": n_pages, "packets": sum(map(len, packets.values())),
        "seconds": max(granule.values()) / rate,
    }
    return b"".join(frames), facts


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of FRAME, and the length before that."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * ((-len(raw)) % FRAME if raw else FRAME), len(raw)


def feature(payload: bytes, facts: dict) -> str:
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    centred = samples - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return (
        f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};seconds={facts['seconds']:.6f};"
        f"sum={int(samples.sum())};energy={int((centred * centred).sum())};peak={int(samples.max())};crossings={crossings}"
    )


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            made = [text_payload(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_ogg(p) for p, _ in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's whole text as an Ogg file.

    A null text counts as empty; an empty text is stored as one frame of spaces. Repeated rows give
    repeated files, equal texts equal bytes; a null id stays null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(media: bytes | None) -> tuple[bytes | None, str | None, str | None]:
    try:
        payload, facts = read_ogg(media)
        return payload, feature(payload, facts), None
    except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
        return None, None, str(e) or type(e).__name__


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            read = [_read(m) for m in part.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("n_bytes"), part.column("media"),
                    *[pa.array(c, t) for c, t in zip(zip(*read, strict=True), (pa.binary(), pa.string(), pa.string()), strict=True)],
                ],
                names=["doc_id", "n_bytes", "media", "payload", "feature", "error"],
            )


def load_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, feature, error) of stored files; a damaged or null file has just an error."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _load, "doc_id long, n_bytes long, media binary, payload binary, feature string, error string"
    )


def op6_media(spark, sf_dir: str) -> DataFrame:
    read = load_media(store_media(table(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op6_media": op6_media}
ORACLE: dict[str, str] = {}
