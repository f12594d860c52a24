"""Media columns: GIF. Payloads are stored as palette images and read back by a full decoder.

The decoder reads any GIF87a or GIF89a: LZW code streams, local and global palettes, interlacing, transparency and
the disposal rules, giving timed frames composed on the canvas, each with a histogram of 64 colours.

Cases: a null or empty text is one row of 64 zero bytes; long texts become several frames of at most 64 x 1024
samples; equal texts give equal values; other columns are ignored; an empty table gives an empty table. A damaged
stream raises ValueError from decode_gif, and in `frames` the row stays with null frames.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WIDTH, MOST_ROWS = 64, 1024
DELAY = 10  # hundredths of a second for each stored frame
# Eight reds, eight greens, four blues; the other palette has them turned round by one channel.
PALETTE = bytes(c for v in range(256) for c in ((v >> 5) * 36, (v >> 2 & 7) * 36, (v & 3) * 85))
ODD_PALETTE = bytes(c for v in range(256) for c in ((v & 3) * 85, (v >> 5) * 36, (v >> 2 & 7) * 36))
_INTERLACED = ((0, 8), (4, 8), (2, 4), (1, 2))


RUN_CODES = 6000


@functools.cache
def _code_widths(first: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, and where each begins: the table's next free code decides, which trails by one."""
    free = np.arange(first + 1, first + 1 + RUN_CODES)
    free[0] = first + 2
    widths = np.minimum(12, np.maximum(first.bit_length(), np.ceil(np.log2(free + 1)).astype(np.int64)))
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The LZW stream of samples below 2**size, with a clear code whenever the table is full."""
    clear = 1 << size
    segments, codes = [[clear << 8]], []
    # Codes are kept eight bits to the left, so that a sample completes the key of a longer string.
    table: dict[int, int] = {}
    free = clear + 2
    get, put = table.get, codes.append
    current = samples[0] << 8 if samples else -1
    for sample in samples[1:]:
        code = get(current | sample)
        if code is not None:
            current = code
            continue
        put(current)
        if free < 4096:
            table[current | sample] = free << 8
            free += 1
        else:
            put(clear << 8)
            segments.append(codes)
            codes = []
            put = codes.append
            table.clear()
            free = clear + 2
        current = sample << 8
    if current >= 0:
        codes.append(current)
    codes.append((clear + 1) << 8)
    segments.append(codes)
    widths = np.concatenate([_code_widths(clear)[0][: len(s)] for s in segments])
    flat = np.concatenate([np.array(s, np.int64) for s in segments]) >> 8
    place = np.arange(12)
    bits = ((flat[:, None] >> place) & 1).astype(np.uint8)[place < widths[:, None]]
    return np.packbits(bits, bitorder="little").tobytes()


def _expanded(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """At most `most` samples of the codes between two clear codes.

    The string that code k adds to the table is the output from where code k begins through the first sample of the
    next code. So every sample of a later code is a copy of an earlier place; places are followed to the literals by
    doubling, for all samples at once.
    """
    order = np.arange(len(codes))
    literal = codes < clear
    above = np.where(literal, order, codes - (clear + 2))  # the code whose string this one prolongs
    if np.any(~literal & (above >= order)):
        raise ValueError("LZW code beyond the table")
    length, root = (~literal).astype(np.int64), above
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        length, root = length + length[root], further
    ends = np.cumsum(length + 1)
    n = min(len(codes), int(np.searchsorted(ends, most)) + 1)
    size, starts = length[:n] + 1, ends[:n] - length[:n] - 1
    source = np.arange(int(ends[n - 1])) - np.repeat(starts - starts[above[:n]], size)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(len(source), np.uint8)
    samples[starts[literal[:n]]] = codes[:n][literal[:n]]
    return samples[source[:most]]


def lzw_decode(stream: bytes, size: int, count: int) -> bytes:
    """The first `count` samples of an LZW stream."""
    clear = 1 << size
    data = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    words = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    out: list[np.ndarray] = []
    made, at, total = 0, 0, len(stream) * 8
    while at < total and made < count:
        # A clear code resets the widths, so codes are read in blocks up to the next one.
        widths, places = _code_widths(clear)
        fits = int(np.searchsorted(places, total - at, "right")) - 1
        starts, widths = at + places[:fits], widths[:fits]
        if fits == RUN_CODES:  # a full table may go on without a clear code
            more = np.arange(at + int(places[-1]), total - 11, 12)
            starts, widths = np.append(starts, more), np.append(widths, np.full(len(more), 12))
        codes = (words[starts >> 3] >> (starts & 7).astype(np.uint32)).astype(np.int64) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        end = int(stops[0]) if len(stops) else len(codes)
        if end:
            out.append(_expanded(codes[:end], clear, count - made))
            made += len(out[-1])
        if not len(stops) or codes[end] == clear + 1:
            break
        at = int(starts[end] + widths[end])
    if made < count:
        raise ValueError("LZW stream ends early")
    return b"".join(x.tobytes() for x in out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A GIF89a that holds the payload, a multiple of 64 bytes, as samples of consecutive frames.

    The common palette serves even frames and a palette of their own the odd ones; NUL, the padding, is transparent;
    frames stay, give way to the background and give way to what was before, in turn.
    """
    most = WIDTH * MOST_ROWS
    parts = [payload[i : i + most] for i in range(0, len(payload), most)]
    height = len(parts[0]) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), PALETTE]
    for i, part in enumerate(parts):
        control = struct.pack("<BHBB", (1 + i % 3) << 2 | 1, DELAY, 0, 0)
        place = struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0x87 if i % 2 else 0)
        out += [b"\x21\xf9\x04", control, b"\x2c", place, ODD_PALETTE if i % 2 else b"", b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    canvas: np.ndarray  # height x width of the whole picture: red, green, blue and alpha from the lowest byte up, alpha 0 where nothing was drawn

    def rgba(self) -> np.ndarray:
        return self.canvas.view(np.uint8).reshape(*self.canvas.shape, 4)


def decode_gif(data: bytes) -> list[Frame]:
    """The timed frames of a GIF, each as drawn on the canvas before its own disposal."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack("<HHB", data[6:11])
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << ((flags & 7) + 1)
        rgb = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        rgba = np.full((max(256, len(rgb)), 4), 255, np.uint8)
        rgba[: len(rgb), :3] = rgb
        rgba[len(rgb) :, :3] = rgb[-1]
        return rgba.view("<u4").reshape(-1), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(out), at + 1

    common, at = palette(flags, at)
    canvas = np.zeros((high, wide), np.uint32)
    frames: list[Frame] = []
    delay, disposal, clear_index, clock = 0, 0, None, 0
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                kind = data[at + 1]
                body, at = blocks(at + 2)
                if kind == 0xF9:
                    disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                    clear_index = body[3] if body[0] & 1 else None
                continue
            if data[at] != 0x2C:
                raise ValueError("unknown GIF block")
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            own, at = palette(flags, at + 10)
            stream, after = blocks(at + 1)
            raw = lzw_decode(stream, data[at], w * h)
            at = after
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(a, h, b) for a, b in _INTERLACED])
                placed = np.empty_like(pixels)
                placed[rows] = pixels
                pixels = placed
            colours = own if own is not None else common
            if colours is None:
                raise ValueError("GIF frame without a palette")
            before = canvas.copy() if disposal == 3 else None
            inside = pixels[: max(0, high - top), : max(0, wide - left)]
            spot = canvas[top : top + inside.shape[0], left : left + inside.shape[1]]
            np.copyto(spot, colours[inside], where=True if clear_index is None else inside != clear_index)
            frames.append(Frame(clock, delay, left, top, w, h, pixels.tobytes(), canvas.copy()))
            clock += delay
            if disposal == 2:
                spot[:] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("GIF ends early") from e
    return frames


def histogram(frame: Frame) -> list[int]:
    """Pixels of the frame's own rectangle by the top two bits of red, green and blue; undrawn pixels are not counted."""
    part = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width].reshape(-1)
    part = part[part >> 24 > 0]
    return np.bincount((part >> 6 & 3) << 4 | (part >> 14 & 3) << 2 | part >> 22 & 3, minlength=64).tolist()


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text), media: the GIF that holds the padded text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode_gif(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FRAME = "struct<frame_no:int,start_ms:int,delay_ms:int,x:int,y:int,width:int,height:int,indices:binary,colours:array<int>>"


def frames(media: DataFrame) -> DataFrame:
    """The media rows with `frames`, an array of timed frames and their colour histograms; null where the stream is damaged."""
    small_batches(media.sparkSession)
    shape = pa.list_(pa.struct([*((n, pa.int32()) for n in ("frame_no", "start_ms", "delay_ms", "x", "y", "width", "height")), ("indices", pa.binary()), ("colours", pa.list_(pa.int32()))]))

    def rows(data: bytes | None) -> list[dict] | None:
        try:
            found = decode_gif(data) if data is not None else None
        except ValueError:
            return None
        return None if found is None else [{"frame_no": i, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "x": f.left, "y": f.top, "width": f.width, "height": f.height, "indices": f.indices, "colours": histogram(f)} for i, f in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.schema.get_field_index("media")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rows(m) for m in media], shape)], [*batch.schema.names, "frames"])

    kept = media.drop("frames")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, frames array<{FRAME}>")
