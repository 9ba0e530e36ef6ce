import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rimefield.llm import ogg


def crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
    return r


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.ogg_crc(data) == crc(data)


def test_round_trip_and_times():
    rng = random.Random(2)
    for n in (0, 1, 575, 576, 577, 5000, 576 * 64 * 2, 200_000):
        data = ogg.pad(rng.randbytes(n))
        assert len(data) % 576 == 0 and data
        streams = ogg.decode(ogg.encode_payload(data))
        assert ogg.read_payload(streams) == data
        assert sum(max(s.granules) for s in streams.values()) == len(data)
        assert all(s.ended for s in streams.values())


def test_packets_over_pages():
    big = [b"a" * 70_000, b"", b"b" * 255, b"c" * 510, b"d"]
    media = b"".join(ogg.stream_pages(9, b"head", big))
    s = ogg.decode(media)[9]
    assert s.packets == [b"head", *big] and s.pages > 2 and max(s.granules) == sum(map(len, big))


def test_damage_is_found():
    media = bytearray(ogg.encode_payload(b"x" * 5760))
    for at in (5, 60, 100, len(media) - 1):
        bad = bytes(media[:at]) + bytes([media[at] ^ 1]) + bytes(media[at + 1 :])
        with pytest.raises(ogg.BadPage):
            ogg.decode(bad)
    with pytest.raises(ogg.BadPage):
        ogg.decode(bytes(media[:-3]))


def test_query_values(spark, tmp_path):
    data = [(1, "héllo"), (2, None), (3, ""), (4, "y" * 100_000), (1, "héllo")]
    spark.createDataFrame(data, "doc_id long, text string").withColumn("feature", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = ogg.query(spark, str(tmp_path)).collect()
    assert len(rows) == 5
    for r in rows:
        raw = (dict(data)[r.doc_id] or "").encode()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(ogg.pad(raw)), zlib.crc32(ogg.pad(raw)[-32:]))
        stored = ogg.encode_payload(ogg.pad(raw))
        assert r.payload_sha256 == hashlib.sha256(ogg.pad(raw)).hexdigest() and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = list(ogg.pad(raw))
        assert r.feature.startswith(f"sum={sum(x)},squares={sum(v * v for v in x)},crossings={sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))};1:pages=")
    media = ogg.encode_column(spark.createDataFrame([(1, b"abc"), (2, None)], "id long, b binary"), "b")
    out = ogg.demux(media, "media", ["id"]).collect()
    assert {r.id for r in out} == {1} and b"".join(bytes(r.data) for r in out if r.packet > 0).startswith(b"abc")


def test_demux_goes_on_after_damage(spark):
    """A damaged page costs its own packets and those that run over it; the other stream and the later pages stay."""
    rng = random.Random(3)
    blocks = [rng.randbytes(576) for _ in range(400)]
    media = ogg.encode_payload(b"".join(blocks))
    starts = [i for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    bad = bytearray(media)
    bad[starts[4] + 200] ^= 1
    df = spark.createDataFrame([(1, "x", bytes(bad)), (2, "y", b"no pages"), (3, "z", media), (4, "n", None), (5, "e", b"")], "id long, fault0 string, media binary")
    rows = ogg.demux(df, "media", ["id", "fault0"]).collect()
    whole = [bytes(r.data) for r in rows if r.id == 3]
    kept = [bytes(r.data) for r in rows if r.id == 1 and r.fault is None]
    lost = ogg._page(media, memoryview(media), starts[4])
    n_lost = sum(v < 255 for v in lost[4])
    assert len(whole) == 402 and len(kept) == 402 - n_lost and set(kept) <= set(whole)
    assert [r.fault for r in rows if r.id == 2] == ["no page at byte 0"] and not [r for r in rows if r.id in (4, 5)]
    faults = [r.fault for r in rows if r.id == 1 and r.fault]
    assert faults[0] == f"checksum of the page at byte {starts[4]}" and "out of order" in faults[-1]
