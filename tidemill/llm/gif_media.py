"""GIF media columns: payloads stored as timed indexed frames, and a GIF decoder.

``encode`` writes bytes losslessly as the samples of 64-wide frames over an
identity grey palette, LZW-coded; payloads above a frame's size become several
timed frames. ``decode`` reads any GIF: LZW code streams with clear codes and
full tables, global and local palettes, transparency, disposal and
interlacing. Both sides work in numpy but for the coder's greedy parse.

LZW is decoded without a dictionary of strings. The entry that a code adds is
the output of that code and one sample more, so every code is a copy of
earlier output: lengths and source positions follow by pointer doubling.

``frames_of`` gives a row a frame, with its time, rectangle, samples and a
histogram of each colour; ``read_media`` a row a file. Frames are played one
at a time on one canvas, so a file of many frames holds no more than one.

Defined results: a null or empty text is an empty payload, stored as 64 zero
bytes; equal texts are equal files; rows that repeat an id are files of their
own, null ids too; very long texts are read whole, as more frames; an empty
table gives an empty result; other columns, whatever their names, are not
looked at; ids must be whole numbers or null. A file that is no GIF, is cut
off, is null, or has a canvas or frame of more than ``MOST_PIXELS`` fails
nothing else: its row has the reason in ``error`` and nulls for all that is
decoded, and ``frames_of`` gives the frames before the fault and then a row
with the reason and no frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import as_binary, batch_of, map_batches, map_slices

WIDTH = 64
#: Rows of a frame at most.
ROWS = 1024
#: Hundredths of a second that a frame is shown.
DELAY = 10
#: Bins of a colour's histogram.
BINS = 16
#: Pixels of the largest canvas or frame that is decoded.
MOST_PIXELS = 1 << 26


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of the n codes after a clear code; size: the minimum code size."""
    first = (1 << size) + 1
    marks = np.minimum(12, np.maximum(size + 1, np.ceil(np.log2(np.arange(first + 1, first + n + 1))).astype(np.int64)))
    marks[:1] = size + 1
    return marks


_WIDTHS = {k: _widths(3840, k) for k in range(2, 9)}


def lzw_codes(data: bytes) -> list[list[int]]:
    """Greedy LZW of 8-bit samples: the codes of each run between clear codes."""
    runs, codes, table, free = [], [], {}, 258
    find, put = table.get, codes.append
    it = iter(data)
    w = next(it)
    for c in it:
        key = w << 8 | c
        x = find(key)
        if x is not None:
            w = x
            continue
        put(w)
        table[key] = free
        free += 1
        w = c
        if free == 4096:
            runs.append(codes)
            codes, table, free = [], {}, 258
            find, put = table.get, codes.append
    put(w)
    runs.append(codes)
    return runs


def lzw_encode(data: bytes) -> bytes:
    """An LZW stream of minimum code size 8."""
    planes = [_planes(np.array([256]), np.array([9]))]
    runs = lzw_codes(data)
    for k, run in enumerate(runs):
        codes = np.array([*run, 256 if k + 1 < len(runs) else 257])
        planes.append(_planes(codes, _WIDTHS[8][: len(codes)]))
    return np.packbits(np.concatenate(planes), bitorder="little").tobytes()


def _planes(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes' bits, least significant first, one a byte; widths rise."""
    out = []
    for b in np.unique(widths):
        own = codes[widths == b].astype(np.uint16)
        out.append(((own[:, None] >> np.arange(b, dtype=np.uint16)) & 1).astype(np.uint8).ravel())
    return np.concatenate(out)


def lzw_decode(stream: bytes, size: int, n: int) -> np.ndarray:
    """The first n samples of an LZW stream; what is missing is 0."""
    clear, end = 1 << size, (1 << size) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    at, runs, made, over = 0, [], 0, False
    while not over and at + size + 1 <= len(bits) and made < n:
        codes, done = [], 0
        while True:  # one run between clear codes; a full table may go on at 12 bits
            widths = _WIDTHS[size] if not done else np.full(4096, 12)
            ends = np.cumsum(widths)
            fit = int(np.searchsorted(ends, len(bits) - at, side="right"))
            got, pos = [], at
            for b in np.unique(widths[:fit]):
                k = int((widths[:fit] == b).sum())
                got.append(bits[pos : pos + k * b].reshape(k, b) @ (1 << np.arange(b)))
                pos += int(k * b)
            got = np.concatenate(got) if got else np.zeros(0, np.int64)
            stop = np.flatnonzero((got == clear) | (got == end))
            if len(stop):
                k = int(stop[0])
                codes.append(got[:k])
                at += int(ends[k])
                over = got[k] == end
                break
            codes.append(got)
            at, done = pos, done + len(got)
            if fit < len(widths):
                over = True
                break
        run = np.concatenate(codes)
        if len(run):
            runs.append(run)
            made += len(run)
    out = np.zeros(n, np.uint8)
    if not runs:
        return out
    codes = np.concatenate(runs)
    bases = np.repeat(np.cumsum([0, *map(len, runs[:-1])]), [len(r) for r in runs])
    here = np.arange(len(codes))
    copied = codes > end
    parent = np.where(copied, codes - end - 1 + bases, here)
    if (parent[copied] >= here[copied]).any():
        raise ValueError("an LZW code is not in the table yet")
    length, up = copied.astype(np.int64), parent.copy()
    while True:  # after k steps, length counts 2**k parents
        further = length + length[up]
        up = up[up]
        if (further == length).all():
            break
        length = further
    length += 1
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1])
    source = np.arange(total) + np.repeat(np.where(copied, starts[parent] - starts, 0), length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    literal = np.zeros(total, np.uint8)
    literal[starts[~copied]] = codes[~copied]
    decoded = literal[source]
    out[: min(n, total)] = decoded[:n]
    return out


@dataclass
class Frame:
    """A frame as shown: the composed canvas, its own rectangle, and hundredths of a second."""

    canvas: np.ndarray  # height x width x 4, RGBA
    left: int
    top: int
    width: int
    height: int
    delay: int


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([min(255, len(data) - k)]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay: int = DELAY) -> bytes:
    """A GIF whose samples are the payload, a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    for top in range(0, rows, ROWS):
        own = payload[top * WIDTH : (top + ROWS) * WIDTH]
        # disposal 2: the canvas is cleared, so that a last, shorter frame stands alone
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(own) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(own)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> list[Frame]:
    """The composed frames of any GIF."""
    return [replace(f, canvas=f.canvas.copy()) for f in played(data)]


def played(data: bytes) -> Iterator[Frame]:
    """The frames one after the other; all share one canvas, which the next frame changes. ValueError: not a whole GIF."""
    try:
        yield from _played(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that is cut off") from e


def _played(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas that is too large")
    at, palette = 13, None
    if flags & 0x80:
        palette, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label, at = data[at + 1], at + 2
            body, at = _joined(data, at)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block in a GIF")
        left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        if w * h > MOST_PIXELS:
            raise ValueError("a frame that is too large")
        at, local = at + 10, palette
        if own & 0x80:
            local, at = _palette(data, at, own)
        size = data[at]
        if not 2 <= size <= 8:
            raise ValueError("an LZW code size that GIF does not have")
        body, at = _joined(data, at + 1)
        index = lzw_decode(body, size, w * h).reshape(h, w)
        if own & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[:, 3] = 255
        if local is not None:
            colours[: len(local), :3] = local
        seen = canvas[top : top + h, left : left + w]
        shown = index[: seen.shape[0], : seen.shape[1]]
        if clear is None:
            seen[:] = colours[shown]
        else:
            opaque = shown != clear
            seen[opaque] = colours[shown[opaque]]
        yield Frame(canvas, left, top, w, h, delay)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas[:] = before
        disposal, delay, clear = 0, 0, None


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if len(data) < at + 3 * n:
        raise ValueError("a GIF that is cut off")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        if len(data) <= at + data[at]:
            raise ValueError("a GIF that is cut off")
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def payload_of(text: bytes) -> bytes:
    """text padded with zero bytes to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def samples(frame: Frame) -> bytes:
    """The red samples of the frame's own rectangle: what ``encode`` stored."""
    return _own(frame)[..., 0].tobytes()


def _own(frame: Frame) -> np.ndarray:
    return frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]


def histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Opaque pixels of the frame's own rectangle by red, by green and by blue: three rows of equal bins."""
    own = _own(frame)
    if not (own[..., 3] == 255).all():
        own = own[own[..., 3] > 0]
    planes = [np.ascontiguousarray(own[..., c]).ravel() for c in range(3)]
    counted = [np.bincount(planes[0], minlength=256).reshape(bins, -1).sum(axis=1)]
    for k in (1, 2):  # a grey frame is counted once
        counted.append(counted[0] if np.array_equal(planes[k], planes[0]) else np.bincount(planes[k], minlength=256).reshape(bins, -1).sum(axis=1))
    return np.stack(counted)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): every text as a GIF."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def step():
        def apply(batch):
            texts = as_binary(batch.column(1)).to_pylist()
            return batch_of(schema, batch.column(0), [len(t) for t in texts], [encode(payload_of(t)) for t in texts])

        return apply

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return map_slices(rows, step, f"{id_col} long, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes stored GIFs: size and digests of samples and file, frames, milliseconds shown, a histogram of each colour, and what was wrong."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "shown_ms", "red", "green", "blue", "error"]
    bins = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), bins, bins, bins, pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (*[None] * 10, "no file")
        file = len(data), hashlib.sha256(data).hexdigest()
        digest, n, tail, frames, shown, counts = hashlib.sha256(), 0, b"", 0, 0, np.zeros((3, BINS), np.int64)
        try:
            for f in played(data):
                own = samples(f)
                digest.update(own)
                n, tail, frames, shown, counts = n + len(own), (tail + own)[-WIDTH:], frames + 1, shown + 10 * f.delay, counts + histogram(f)
        except ValueError as e:
            return (None, None, None, *file, *[None] * 5, str(e))
        return (n, digest.hexdigest(), zlib.crc32(tail), *file, frames, shown, *counts.tolist(), None)

    def step():
        return lambda batch: batch_of(schema, batch.column(0), batch.column(1), *(list(c) for c in zip(*map(row, batch.column(2).to_pylist()), strict=True)))

    ddl = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, shown_ms long, red array<long>, green array<long>, blue array<long>, error string"
    rows = media.select(F.col(id_col).cast("long").alias(id_col), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return map_slices(rows, step, ddl, column="media")


def frames_of(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row a frame of every GIF, as it is shown: when and how long, its rectangle, the rectangle's RGBA pixels and a histogram of each colour."""
    bins = pa.list_(pa.int64())
    numbers = ["frame", "start_ms", "shown_ms", "left", "top", "width", "height"]
    schema = pa.schema([(id_col, pa.int64()), *[(c, pa.int64()) for c in numbers], ("pixels", pa.binary()), ("red", bins), ("green", bins), ("blue", bins), ("error", pa.string())])

    def frames(key: int | None, data: bytes | None) -> Iterator[tuple]:
        at = 0
        try:
            if data is None:
                raise ValueError("no file")
            for k, f in enumerate(played(data)):
                yield key, k, at, 10 * f.delay, f.left, f.top, f.width, f.height, _own(f).tobytes(), *histogram(f).tolist(), None
                at += 10 * f.delay
        except ValueError as e:
            yield key, *[None] * 11, str(e)

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in frames(key, data.as_py()):
                    held.append(row)
                    size += len(row[8] or b"")
                    if size > 4 << 20:
                        yield batch_of(schema, *(list(c) for c in zip(*held, strict=True)))
                        held, size = [], 0
            if held:
                yield batch_of(schema, *(list(c) for c in zip(*held, strict=True)))

    longs = ", ".join(f"`{c}` long" for c in [id_col, *numbers])
    ddl = f"{longs}, pixels binary, red array<long>, green array<long>, blue array<long>, error string"
    return map_batches(media.select(F.col(id_col).cast("long").alias(id_col), "media"), run, ddl)
