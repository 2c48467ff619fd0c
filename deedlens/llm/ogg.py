"""Ogg media columns: pages, checksums, lacing, logical streams, granule times.

``encode`` stores 8-bit samples in an Ogg physical stream (a header packet, then
packets of 576 samples); ``read_pages`` verifies every page's checksum,
``demultiplex`` reassembles the packets of every logical stream from the lacing
values, continued packets included, and derives times from granule positions.

Edge cases: a null text is empty; an empty payload is still one block of
padding; repeated rows give equal values (the serial number is derived from the
payload); extra columns are ignored; an empty table gives no rows.  A damaged
page, a lost page or a packet without its beginning raises ``OggError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, table, text_blocks

BLOCK = 576  # samples in a packet; payloads are a multiple of it
RATE = 8000  # samples a second
PAD = 255

# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
PAGE_HEADER = struct.Struct("<4sBBqIIIB")
CODEC = struct.Struct("<8sHHIIBBHI")
CODEC_MAGIC = b"PCM     "
FORMAT_U8 = 1

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The stored bytes are not an intact Ogg stream."""


def page_crc(page: bytes) -> int:
    """The page checksum: CRC-32 most significant bit first, no inversions.

    It is the mirrored CRC of the mirrored bytes, which zlib computes.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    """Lacing values of one packet."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Page:
    """One verified page."""

    flags: int
    granule: int
    serial: int
    sequence: int
    laces: bytes
    body: bytes


def write_page(page: Page) -> bytes:
    """The page's bytes with their checksum."""
    head = PAGE_HEADER.pack(CAPTURE, 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.laces))
    raw = head + page.laces + page.body
    return raw[:22] + page_crc(raw).to_bytes(4, "little") + raw[26:]


def write_stream(packets: list[bytes], granules: list[int], serial: int, first: int = 0, begin: bool = True, end: bool = True) -> list[bytes]:
    """Pages of one logical stream; packets longer than a page continue on the next."""
    pages: list[Page] = []
    laces, body, granule, continued = bytearray(), bytearray(), NO_PACKET_ENDS, False

    def close(then_continued: bool) -> None:
        nonlocal laces, body, granule, continued
        pages.append(Page(CONTINUED * continued, granule, serial, first + len(pages), bytes(laces), bytes(body)))
        laces, body, granule, continued = bytearray(), bytearray(), NO_PACKET_ENDS, then_continued

    for k, (packet, at) in enumerate(zip(packets, granules)):
        values, offset = lacing(len(packet)), 0
        if len(laces) + len(values) > 255 and laces and len(values) <= 255:
            close(False)  # a packet that fits a page is kept whole
        while values:
            take = values[: 255 - len(laces)]
            size = sum(take)
            laces += take
            body += packet[offset : offset + size]
            offset, values = offset + size, values[len(take):]
            if values:
                close(True)
        granule = at
        if begin and k == 0:
            close(False)  # the first packet has its own page
    if laces:
        close(False)
    if begin and pages:
        pages[0].flags |= FIRST
    if end and pages:
        pages[-1].flags |= LAST
    return [write_page(p) for p in pages]


def read_pages(data: bytes):
    """Verified pages in file order."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < PAGE_HEADER.size:
            raise OggError(f"cut page header at byte {at}")
        magic, version, flags, granule, serial, sequence, crc, n = PAGE_HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        body_at = at + PAGE_HEADER.size + n
        laces = bytes(view[at + PAGE_HEADER.size : body_at])
        end = body_at + sum(laces)
        if len(laces) < n or end > len(data):
            raise OggError(f"cut page at byte {at}")
        raw = bytes(view[at:end])
        if page_crc(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        yield Page(flags, granule, serial, sequence, laces, raw[PAGE_HEADER.size + n :])
        at = end


@dataclass
class Stream:
    """One logical stream: packets and the time at which each page's last one ends."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (packets so far, granule)
    pages: int = 0
    open_packet: bytes = b""
    is_open: bool = False
    finished: bool = False

    def seconds(self, rate: int) -> list[float]:
        """End time of every page with a completed packet."""
        return [g / rate for _, g in self.ends]


def demultiplex(data: bytes) -> list[Stream]:
    """The logical streams of an Ogg file, in order of their first pages."""
    streams: dict[int, Stream] = {}
    for page in read_pages(data):
        s = streams.get(page.serial)
        if s is None:
            if not page.flags & FIRST:
                raise OggError(f"stream {page.serial} has no first page")
            s = streams[page.serial] = Stream(page.serial)
        if page.sequence != s.pages:
            raise OggError(f"page {s.pages} of stream {page.serial} is lost")
        if bool(page.flags & CONTINUED) != s.is_open:
            raise OggError("a continued packet is lost")
        s.pages += 1
        at, start, completed = 0, 0, False
        body = page.body
        for value in page.laces:
            at += value
            if value < 255:
                packet = body[start:at]
                if s.is_open:
                    packet, s.open_packet, s.is_open = s.open_packet + packet, b"", False
                s.packets.append(packet)
                start, completed = at, True
        if start < at or (page.laces and page.laces[-1] == 255):
            s.open_packet, s.is_open = s.open_packet + body[start:at], True
        if completed and page.granule != NO_PACKET_ENDS:
            s.ends.append((len(s.packets), page.granule))
        s.finished |= bool(page.flags & LAST)
    for s in streams.values():
        if s.is_open or not s.finished:
            raise OggError(f"stream {s.serial} does not end")
    return list(streams.values())


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the block."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as an Ogg file; granule positions count samples."""
    serial = zlib.crc32(payload)
    head = CODEC.pack(CODEC_MAGIC, 0, 0, FORMAT_U8, rate, 8, 1, BLOCK, 0)
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    granules = list(range(BLOCK, len(payload) + 1, BLOCK))
    return b"".join(write_stream([head, *blocks], [0, *granules], serial))


def decode(media: bytes) -> tuple[bytes, Stream, int]:
    """The samples of the first PCM stream, that stream and its rate."""
    for stream in demultiplex(media):
        head = stream.packets[0] if stream.packets else b""
        if head[:8] == CODEC_MAGIC:
            _, _, _, form, rate, _, channels, _, _ = CODEC.unpack(head)
            if form != FORMAT_U8 or channels != 1:
                raise OggError("not 8-bit mono")
            return b"".join(stream.packets[1:]), stream, rate
    raise OggError("no PCM stream")


def features(samples: bytes, stream: Stream, rate: int) -> str:
    """Length, level and spectrum-like figures of the samples read back."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    levels = np.arange(256) - 128
    mean = float(counts @ levels) / n
    rms = (float(counts @ (levels * levels)) / n) ** 0.5
    used = counts[counts > 0] / n
    entropy = abs(float((used * np.log2(used)).sum()))
    high = x > 127
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    seconds = stream.ends[-1][1] / rate
    return (
        f"rate={rate};pages={stream.pages};packets={len(stream.packets) - 1};seconds={seconds:.4f};"
        f"mean={mean:.4f};rms={rms:.4f};entropy={entropy:.4f};crossings={crossings}"
    )


#: Bytes of texts that are Python objects at a time.
BLOCK_BYTES = 4_000_000
FIELDS = (
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
)


def digest(data: bytes) -> tuple:
    """One text's row: stored, read back, measured."""
    media = encode(padded(data))
    payload, stream, rate = decode(media)
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), features(payload, stream, rate),
    )


def media_column(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with its text stored as an Ogg binary column."""
    fields = [f for f in df.schema.fields if f.name != media_col]
    names = [f.name for f in fields]
    places = [f"c{i}" for i in range(len(names))]  # a name may hold dots, which Spark reads as a path
    out = df.select(*(F.col("`" + x.replace("`", "``") + "`").alias(c) for x, c in zip(names, places)), full_text(text_col).cast("binary").alias("__payload"))

    def store(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, len(places), BLOCK_BYTES):
                media = pa.array([encode(padded(x or b"")) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], media], [*places, "media"])

    schema = out.select(*places).schema.add("media", "binary")
    return out.mapInArrow(store, schema).toDF(*names, media_col)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as Ogg, reads it back, and returns the figures."""
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).cast("binary").alias("data"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def measure(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, "data", BLOCK_BYTES):
                found = zip(*(digest(x or b"") for x in texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *(pa.array(v, t) for v, (_, t) in zip(found, FIELDS))],
                    ["doc_id", *(n for n, _ in FIELDS)],
                )

    return rows.mapInArrow(measure, schema)


def op7_media_columns(spark, sf_dir):
    """Query op7: every text of ``documents`` stored as Ogg and read back."""
    return media_digests(table(spark, sf_dir, "documents"))
