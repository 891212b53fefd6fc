import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tidemill.llm import gif_media as g


def plain_lzw(stream, size):
    """The textbook decoder."""
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little").tolist()
    clear, end, at, out, width = 1 << size, (1 << size) + 1, 0, [], size + 1
    table, before = None, None
    while at + width <= len(bits):
        code = sum(b << k for k, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == end:
            break
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
        out.append(entry)
        before = entry
        if len(table) == 1 << width and width < 12:
            width += 1
    return b"".join(out)


def payloads():
    rng = random.Random(1)
    out = [b"\0" * 64, b"a" * 64, b"a" * 200_000, bytes(range(256)) * 300, rng.randbytes(70_016)]
    out.append("".join(rng.choice(["the ", "of ", "tion", "é"]) for _ in range(40_000)).encode())
    return [g.payload_of(x) for x in out]


@pytest.mark.parametrize("k", range(6))
def test_lzw_is_the_textbook_one(k):
    data = payloads()[k][:65_536]
    stream = g.lzw_encode(data)
    assert plain_lzw(stream, 8) == data
    assert g.lzw_decode(stream, 8, len(data)).tobytes() == data


@pytest.mark.parametrize("k", range(6))
def test_payload_round_trip(k):
    data = payloads()[k]
    frames = g.decode(g.encode(data))
    assert b"".join(map(g.samples, frames)) == data
    want = np.bincount(np.frombuffer(data, np.uint8) >> 4, minlength=16).tolist()
    assert sum(map(g.histogram, frames)).tolist() == [want] * 3
    assert len(frames) == -(-len(data) // 65_536) and all(f.delay == g.DELAY for f in frames)


def test_padding():
    assert [len(g.payload_of(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def lzw_literal(samples, size):
    """Codes without any table: a clear code before each sample."""
    codes = [c for s in samples for c in (1 << size, s)] + [(1 << size) + 1]
    bits = "".join(format(c, f"0{size + 1}b")[::-1] for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def frame(samples, left, top, w, h, disposal=0, clear=None, local=None, interlaced=False):
    packed = disposal << 2 | (clear is not None)
    out = b"\x21\xf9\x04" + struct.pack("<BHB", packed, 5, clear or 0) + b"\0\x21\xfe\x03abc\0"
    flags = (0x80 | 1 if local else 0) | (0x40 if interlaced else 0)
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (bytes(local) if local else b"")
    return out + b"\x02" + g._blocks(lzw_literal(samples, 2))


def gif(*frames):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", 2, 4, 0x80 | 1, 0, 0) + palette + b"".join(frames) + b"\x3b"


def colours(f):
    names = {(0, 0, 0, 0): ".", (0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (9, 9, 9, 255): "l"}
    return "".join(names[tuple(p)] for p in f.canvas.reshape(-1, 4).tolist())


def test_disposal_transparency_palettes_and_interlacing():
    full = [1] * 8
    patch = [2, 3]
    for disposal, after in ((0, "rrgbrrkr"), (1, "rrgbrrkr"), (2, "rr..rrkr"), (3, "rrrrrrkr")):
        got = g.decode(gif(frame(full, 0, 0, 2, 4), frame(patch, 0, 1, 2, 1, disposal), frame([0], 0, 3, 1, 1)))
        assert [colours(f) for f in got] == ["rrrrrrrr", "rrgbrrrr", after]
    got = g.decode(gif(frame(full, 0, 0, 2, 4), frame([2, 3], 0, 0, 2, 1, clear=2)))
    assert colours(got[1]) == "rbrrrrrr"
    got = g.decode(gif(frame([1, 1], 0, 0, 2, 1, local=[9, 9, 9] * 4)))
    assert colours(got[0]) == "ll......"
    got = g.decode(gif(frame([0, 0, 1, 1, 2, 2, 3, 3], 0, 0, 2, 4, interlaced=True)))
    assert colours(got[0]) == "kkggrrbb"


def test_deferred_clear_codes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 4, 60_000).astype(np.uint8).tobytes()
    table, free, codes, w = {bytes([i]): i for i in range(4)}, 6, [4], b""
    for c in data:
        if w + bytes([c]) in table:
            w += bytes([c])
        else:
            codes.append(table[w])
            if free < 4096:
                table[w + bytes([c])] = free
                free += 1
            w = bytes([c])
    codes += [table[w], 5]
    bits, n = [], 0
    for i, c in enumerate(codes):
        width = 3 if i < 2 else min(12, max(3, (5 + i - 1).bit_length()))
        bits += [c >> k & 1 for k in range(width)]
        n += 1
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert plain_lzw(stream, 2) == data
    assert g.lzw_decode(stream, 2, len(data)).tobytes() == data


def test_table_of_media(spark):
    texts = {1: None, 2: "", 3: "abc", 4: "é" * 50_000, 5: "abc"}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in g.read_media(g.store_media(df)).collect()}
    for i, t in texts.items():
        p = g.payload_of((t or "").encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        assert r["media_sha256"] == hashlib.sha256(g.encode(p)).hexdigest()
    assert got[3].asDict() | {"doc_id": 5} == got[5].asDict() and got[4]["n_frames"] == 2
    assert g.read_media(g.store_media(df.limit(0))).count() == 0


def test_histogram_of_each_colour_counts_what_is_opaque():
    got = g.decode(gif(frame([1] * 8, 0, 0, 2, 4), frame([2, 3], 0, 0, 2, 1), frame([2, 3], 0, 1, 2, 1, clear=2)))
    assert [g.histogram(f)[:, [0, 15]].tolist() for f in got] == [[[0, 8], [8, 0], [8, 0]], [[2, 0], [1, 1], [1, 1]], [[1, 1], [2, 0], [1, 1]]]
    alone = g.decode(gif(frame([2, 3], 0, 0, 2, 1, clear=2)))[0]
    assert g.histogram(alone).sum() == 3 and g.histogram(alone)[2, 15] == 1


def test_broken_files_are_rows_with_a_reason(spark):
    good = gif(frame([1] * 8, 0, 0, 2, 4), frame([2, 3], 0, 1, 2, 1))
    long = g.encode(g.payload_of(b"some text " * 90))
    for whole in (good, long):
        for n in range(len(whole)):
            with pytest.raises(ValueError):
                g.decode(whole[:n])
    rng = random.Random(7)
    for _ in range(2000):  # any bytes decode or end in a ValueError
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(10, len(data))] = rng.randrange(256)
        try:
            g.decode(bytes(data))
        except ValueError:
            pass
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    files = [(1, good), (2, good[:-1]), (3, None), (4, b"no picture"), (5, b""), (None, good), (1, good), (6, huge)]
    df = spark.createDataFrame([(i, x, len(x or b""), "x") for i, x in files], "doc_id long, media binary, n_bytes int, red string")
    got = g.read_media(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in files)
    for r in got:
        whole = r["doc_id"] in (1, None)
        assert (r["error"] is None) == whole and (r["n_frames"] == 2) == whole and (r["payload_sha256"] is None) != whole
        assert (r["media_sha256"] is None) == (r["doc_id"] == 3)
    table = g.frames_of(df).collect()
    by = {}
    for r in table:
        by.setdefault(r["doc_id"], []).append(r)
    assert [len(by[i]) for i in (1, 2, 3, 4, 5, 6, None)] == [4, 3, 1, 1, 1, 1, 2]
    first, second = sorted(by[None], key=lambda r: r["frame"])
    assert (first["start_ms"], first["shown_ms"], second["start_ms"], second["top"], second["height"]) == (0, 50, 50, 1, 1)
    assert bytes(second["pixels"]) == bytes([0, 255, 0, 255, 0, 0, 255, 255]) and second["blue"][15] == 1
    assert [r["error"] is None for r in sorted(by[2], key=lambda r: r["frame"] is None)] == [True, True, False]
    assert g.frames_of(df.limit(0)).count() == 0


def test_feature_of_the_query_is_what_the_payload_holds(spark, tmp_path):
    from tidemill.llm.queries import op4_gif_media

    texts = [None, "", "abc", "é\n" * 50_000, "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["feature"] for r in op4_gif_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        p = g.payload_of((t or "").encode())
        frames = -(-len(p) // 65_536)
        bins = ",".join(map(str, np.bincount(np.frombuffer(p, np.uint8) >> 4, minlength=16)))
        assert got[i] == f"frames={frames};ms={100 * frames};red={bins};green={bins};blue={bins}"
