import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelight.llm import gif, queries
from tests.llm.helpers import EDGE_TEXTS, documents


def test_lzw_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 2, 300, 20_000):
        for top in (1, 2, 256):
            data = bytes(rng.randrange(top) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data


def _gif(frames, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = [b"GIF89a", struct.pack("<HHBBB", 2, 2, 0x81, 0, 0), palette]
    for pixels, delay, disposal, clear in frames:
        flags = disposal << 2 | (clear is not None)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", flags, delay, clear or 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, 2, 2, 0), b"\x02", gif._blocks(gif.lzw_encode(pixels, 2))]
    return b"".join([*out, b"\x3b"])


def test_palette_transparency_disposal_and_times():
    frames = gif.decode_gif(_gif([(b"\1\1\1\1", 5, 1, None), (b"\0\2\2\0", 7, 3, 0), (b"\0\0\0\3", 2, 2, 0), (b"\0\0\0\0", 1, 0, 0)]))
    assert [(f.start_ms, f.delay_ms) for f in frames] == [(0, 50), (50, 70), (120, 20), (140, 10)]
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    seen = [[tuple(map(int, p)) for p in f.rgba().reshape(-1, 4)] for f in frames]
    assert seen[0] == [red] * 4 and seen[1] == [red, green, green, red] and seen[2] == [red, red, red, blue]  # the second was undone
    assert all(p[3] == 0 for p in seen[3])  # the third cleared its place
    assert sum(gif.histogram(frames[1])) == 4 and gif.histogram(frames[1])[48] == 2


def test_damaged_stream(spark):
    good = gif.encode_gif(bytes(64))
    for bad in (b"", good[:40], b"PNG" + good[3:], good[:-30]):
        with pytest.raises(ValueError):
            gif.decode_gif(bad)
    rows = gif.frames(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:30])), (3, None)], "doc_id long, media binary")).collect()
    assert [r.frames is None for r in sorted(rows)] == [False, True, True]


def test_texts_read_back(spark):
    read = gif.frames(gif.store(documents(spark, [*EDGE_TEXTS, "y" * 200_000]).withColumn("media", F.lit(0)))).collect()
    for r in read:
        text = [*EDGE_TEXTS, "y" * 200_000][r.doc_id] or ""
        data = b"".join(bytes(f.indices) for f in r.frames)
        assert data.rstrip(b"\0") == text.encode() and len(data) % 64 == 0 and len(data) >= 64
    assert gif.store(documents(spark, [])).count() == 0
    assert np.uint32(zlib.crc32(b"")) == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def slow_lzw(codes, clear):
    """A table of strings, code by code."""
    table, out, before = [bytes([i]) for i in range(clear)] + [b"", b""], [], None
    for code in codes:
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
        out.append(entry)
        before = entry
    return b"".join(out)


def test_codes_expand_as_a_table_of_strings():
    """Streams of any valid codes, also of encoders that are not greedy, and long runs without a clear code."""
    rng = random.Random(2)
    for n in (1, 2, 50, 6000):
        codes = [rng.randrange(4)]
        for k in range(1, n):
            codes.append(rng.choice([rng.randrange(4), rng.randrange(6, min(4095, 5 + k) + 1)]) if k > 1 or rng.random() < 0.5 else 6)
        want = slow_lzw(codes, 4)
        assert gif._expanded(np.array(codes), 4, len(want)).tobytes() == want
        assert gif._expanded(np.array(codes), 4, len(want) // 2 + 1).tobytes() == want[: len(want) // 2 + 1]
    with pytest.raises(ValueError):
        gif._expanded(np.array([1, 7]), 4, 10)


def test_query_over_the_whole_table(spark, sf_dir):
    """Every payload read back from the stored form; features and forms of equal texts are equal."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_gif_media(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    seen = {}
    for r in rows:
        data = texts[r.doc_id]
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        form = seen.setdefault(data, (r.media_bytes, r.media_sha256, r.feature))
        assert form == (r.media_bytes, r.media_sha256, r.feature)
        frames, colours = r.feature.split(":")
        assert int(frames) == -(-len(padded) // (64 * 1024)) and sum(map(int, colours.split(","))) == sum(b != 0 for b in padded)
    assert max(sum(int(c) > 0 for c in r.feature.split(":")[1].split(",")) for r in rows) > 10


def test_stored_frames_have_palettes_disposals_and_clear_pixels():
    data = bytes(range(128)) * 8 * 64 * 3
    frames = gif.decode_gif(gif.encode_gif(data))
    assert len(frames) == 3 and [f.start_ms for f in frames] == [0, 100, 200]
    assert b"".join(f.indices for f in frames) == data
    first, second = gif.histogram(frames[0]), gif.histogram(frames[1])
    assert first != second and sum(first) == sum(second) == 64 * 1024 * 127 // 128 and sum(c > 0 for c in first) == 32
