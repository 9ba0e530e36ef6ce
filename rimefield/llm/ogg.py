"""Ogg media: pages with checksums, packets from lacing values, logical streams by serial number, times from granules.

encode_payload() stores bytes losslessly: a head packet opens each of two logical streams, the payload's packets of
576 bytes go to the streams in turn, pages of both are interleaved. A sample is one byte; the granule position of a
page is the number of the stream's samples up to its last finished packet. decode() takes any Ogg bytes: it verifies
each page's CRC, joins packets that run over pages, sorts pages by stream and gives times at the stream's rate.

Null and empty texts are stored as one block of padding. Equal texts give equal values; rows are independent, so
repeated rows and extra columns don't matter, and an empty table gives no rows. decode() raises BadPage at a damaged
page; demux() names the fault in a row of its own and goes on at the next page whose checksum holds, without the
packets that the damaged page began, held or ended.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, RATE, PER_PAGE = 576, 8000, 64
#: Bytes with their bits in reverse: Ogg's checksum is CRC-32 with the polynomial 04c11db7 and the highest bit first,
#: so it equals zlib's over reversed bytes, read backwards.
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class BadPage(ValueError):
    pass


def ogg_crc(data: bytes) -> int:
    raw = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(MIRROR), "big")


def page(serial: int, number: int, granule: int, lacing: bytes, body: bytes, first=False, last=False, goes_on=False) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, goes_on | first << 1 | last << 2, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = ogg_crc(head + body)
    return b"".join((head[:22], struct.pack("<I", crc), head[26:], body))


def stream_pages(serial: int, head: bytes, packets: list[bytes]) -> Iterator[bytes]:
    """The pages of one logical stream: the head on a page of its own, then up to 255 lacing values a page."""
    yield page(serial, 0, 0, bytes([len(head)]), head, first=True, last=not packets)
    number, granule, done, lacing, body, goes_on = 1, 0, -1, bytearray(), [], False
    for k, p in enumerate(packets):
        values, at = [255] * (len(p) // 255) + [len(p) % 255], 0
        for i, v in enumerate(values):
            if len(lacing) == 255:
                yield page(serial, number, done, bytes(lacing), b"".join(body), goes_on=goes_on)
                number, done, lacing, body, goes_on = number + 1, -1, bytearray(), [], i > 0
            lacing.append(v)
            body.append(p[at : at + v])
            at += v
        granule += len(p)
        done = granule
        if (k + 1) % PER_PAGE == 0 and k + 1 < len(packets):
            yield page(serial, number, done, bytes(lacing), b"".join(body), goes_on=goes_on)
            number, done, lacing, body, goes_on = number + 1, -1, bytearray(), [], False
    if packets:
        yield page(serial, number, done, bytes(lacing), b"".join(body), last=True, goes_on=goes_on)


def encode_payload(payload: bytes) -> bytes:
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    heads = [struct.pack("<8sBIQ", b"\x80bytes8\0", k, RATE, len(payload)) for k in (0, 1)]
    a, b = (list(stream_pages(k + 1, heads[k], blocks[k::2])) for k in (0, 1))
    out = []
    for i in range(max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    part: list[bytes] = field(default_factory=list)
    next_page: int = 0
    pages: int = 0
    ended: bool = False

    def seconds(self, rate: int = RATE) -> float:
        return max(self.granules, default=0) / rate


def _page(data: bytes, view: memoryview, at: int):
    """(flags, granule, serial, number, lacing, start, end) of the page at a byte; BadPage if there is none."""
    if data[at : at + 4] != b"OggS" or at + 27 > len(data):
        raise BadPage(f"no page at byte {at}")
    _, version, flags, granule, serial, number, crc = struct.unpack_from("<4sBBqIII", data, at)
    n = data[at + 26]
    lacing = data[at + 27 : at + 27 + n]
    start = at + 27 + n
    end = start + sum(lacing)
    if version or len(lacing) < n or end > len(data):
        raise BadPage(f"page at byte {at} is cut off or of another version")
    if ogg_crc(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
        raise BadPage(f"checksum of the page at byte {at}")
    return flags, granule, serial, number, lacing, start, end


def decode(data: bytes, faults: list[str] | None = None) -> dict[int, Stream]:
    """Logical streams by serial number. granules: for each page on which a packet ends, its position. Without a list for faults the
    first one raises BadPage."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(data)

    def fault(text: str) -> None:
        if faults is None:
            raise BadPage(text)
        faults.append(text)

    while at < len(data):
        try:
            flags, granule, serial, number, lacing, start, end = _page(data, view, at)
        except BadPage as e:
            fault(str(e))
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Stream())
        rest = False
        if number != s.next_page or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(s.part):
            fault(f"page {number} of stream {serial} is out of order")
            s.part, rest = [], bool(flags & 1)
        s.next_page, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & 4)
        for v in lacing:
            s.part.append(data[start : start + v])
            start += v
            if v < 255:
                if not rest:
                    s.packets.append(b"".join(s.part))
                s.part, rest = [], False
        if rest:
            s.part = []
        if granule >= 0:
            s.granules.append(granule)
        at = end
    return streams


def read_payload(streams: dict[int, Stream]) -> bytes:
    a, b = (streams[k].packets[1:] for k in (1, 2))
    out = [b""] * (len(a) + len(b))
    out[0::2], out[1::2] = a, b
    return b"".join(out)


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_py() or b""
            media = encode_payload(pad(raw))
            streams = decode(media)
            got = read_payload(streams)
            x = np.frombuffer(got, np.uint8).astype(np.int64)
            feature = f"sum={x.sum()},squares={(x * x).sum()},crossings={np.count_nonzero(np.diff(x >= 128))};" + ";".join(f"{k}:pages={s.pages},packets={len(s.packets)},granule={max(s.granules)},seconds={s.seconds():.6f}" for k, s in sorted(streams.items()))
            rows.append((doc_id, len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in FEATURES.split(", ")])


def encode_column(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """Adds the Ogg bytes of a binary column; null stays null."""
    at = df.columns.index(column)

    def rows(batches):
        for b in batches:
            media = [None if x is None else encode_payload(pad(x)) for x in (v.as_py() for v in b.column(at))]
            yield pa.record_batch([*b.columns, pa.array(media, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(rows, df.select("*", F.lit(None).cast("binary").alias(out)).schema)


def demux(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per packet of the Ogg bytes in a column: keep, serial, packet, data, fault; null has no packets. A fault has a row with
    the text of it, and null for the rest."""
    schema = df.select(*keep).schema.add("serial", "long").add("packet", "long").add("data", "binary").add("fault", "string")

    def rows(batches):
        for b in batches:
            at, got = [], []
            for i, v in enumerate(b.column(len(keep))):
                if v.is_valid:
                    faults: list[str] = []
                    for serial, s in sorted(decode(v.as_py(), faults).items()):
                        got += [(serial, n, p, None) for n, p in enumerate(s.packets)]
                    got += [(None, None, None, f) for f in faults]
                    at += [i] * (len(got) - len(at))
            if got:
                taken = pa.array(at, pa.int64())
                types = (pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.record_batch([*(c.take(taken) for c in b.columns[: len(keep)]), *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True))], schema.names)

    return df.select(*keep, column).mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(features, FEATURES)
