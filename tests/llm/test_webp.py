"""Round trips of the WebP codec through every transform and token kind."""

import numpy as np
import pytest

from tidemark.llm import media, webp
from tidemark.llm import webp
from tidemark.llm.webp import CACHE_MULTIPLIER, NEAR, Bits, Sink, _channels, _head, _pack, cross_colour, predicted, write_tokens


def subimage(sink, values):
    sink.put(0, 1)
    write_tokens(sink, [("p", int(v)) for v in values], 0)


def tokens_of(pixels, width, cache_bits, copies):
    out, cache, at = [], {}, 0
    px = [int(p) for p in pixels]
    while at < len(px):
        best = (0, 0)
        if copies:
            for d in (1, 2, width, width + 1, 200):
                if d <= at:
                    n = 0
                    while at + n < len(px) and px[at + n] == px[at + n - d]:
                        n += 1
                    best = max(best, (n, d))
        key = (CACHE_MULTIPLIER * px[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best[0] >= 3:
            n, d = best
            near = [k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d]
            out.append(("b", n, near[0] if near else d + 120))
        elif cache_bits and cache.get(key, 0) == px[at]:
            out.append(("c", key))
            n = 1
        else:
            out.append(("p", px[at]))
            n = 1
        for k in range(at, at + n):
            if cache_bits:
                cache[(CACHE_MULTIPLIER * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        at += n
    return out


def encode(pixels, width, height, transforms=(), cache_bits=0, copies=False, meta=False):
    rng = np.random.default_rng(5)
    sink, now = _head(width, height), width
    for kind in transforms:
        sink.put(1 | kind << 1, 3)
        across, down = -(-now // 4), -(-height // 4)
        if kind == webp.PREDICTOR:
            modes = rng.integers(0, 14, across * down)
            sink.put(0, 3)
            subimage(sink, 0xFF000000 | modes.astype(np.uint32) << 8)
            image = _channels(pixels).reshape(height, now, 4)
            residual = np.zeros_like(image)
            for y in range(height):
                for x in range(now):
                    residual[y, x] = (image[y, x] - predicted(image, x, y, int(modes[(y >> 2) * across + (x >> 2)]))) & 255
            pixels = _pack(residual).ravel()
        elif kind == webp.CROSS_COLOUR:
            f = 0xFF000000 | rng.integers(0, 1 << 24, across * down).astype(np.uint32)
            sink.put(0, 3)
            subimage(sink, f)
            pixels = cross_colour(pixels, now, height, 2, f, -1)
        elif kind == webp.SUBTRACT_GREEN:
            c = _channels(pixels)
            c[:, 1] -= c[:, 2]
            c[:, 3] -= c[:, 2]
            pixels = _pack(c)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            n = len(colours)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            sink.put(n - 1, 8)
            subimage(sink, _pack(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.int16))))
            rows = np.zeros((height, -(-now // (1 << shift))), np.uint32)
            for x in range(now):
                rows[:, x >> shift] |= index.reshape(height, now)[:, x].astype(np.uint32) << np.uint32((x % (1 << shift)) * (8 >> shift))
            pixels, now = 0xFF000000 | rows.ravel() << 8, rows.shape[1]
    sink.put(0, 1)
    sink.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if meta:
        sink.put(1, 1)
        sink.put(0, 3)
        subimage(sink, np.full(-(-now // 4) * -(-height // 4), 0xFF000000, np.uint32))
    else:
        sink.put(0, 1)
    write_tokens(sink, tokens_of(pixels, now, cache_bits, copies), cache_bits)
    return webp.wrap(sink.value.to_bytes((sink.n + 7) // 8, "little"))


def sample(n_colours, width, height, seed=1):
    rng = np.random.default_rng(seed)
    colours = rng.integers(0, 1 << 32, n_colours, dtype=np.uint64).astype(np.uint32)
    px = colours[rng.integers(0, n_colours, width * height)]
    px[20:60] = px[0]
    return px


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)])
def test_round_trip(transforms, copies, cache_bits):
    for colours, width, height in ((2, 13, 7), (4, 9, 9), (15, 17, 6), (200, 23, 11)):
        px = sample(colours, width, height)
        w, h, out = webp.decode(encode(px, width, height, transforms, cache_bits, copies))
        assert (w, h) == (width, height)
        assert (out == px).all()


def test_meta_prefix_image():
    px = sample(50, 14, 10)
    assert (webp.decode(encode(px, 14, 10, (2,), 3, True, meta=True))[2] == px).all()


def test_near_distances_begin_as_specified():
    assert NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and len(NEAR) == 120 and NEAR[-1] == (8, 7)


@pytest.mark.parametrize("raw", [b"", b"a", b"\0" * 64, b"\0" * 63, bytes(range(256)) * 3, b"ab" * 500_000, "é".encode() * 99, np.random.default_rng(0).bytes(300_000)])
def test_store_and_load(raw):
    stored = media.store(raw)
    payload = media.load(stored)
    assert payload == media.payload_of(raw) and len(payload) % 64 == 0 and len(payload) > 0
    w, h, px = webp.decode(stored)
    assert ((px >> 24) == 255).all() and ((px >> 16 & 255) == (px & 255)).all()


def test_skewed_counts_stay_within_fifteen_bits():
    raw = b"".join(bytes([k]) * min(1 << k, 200_000) for k in range(20))
    assert media.load(media.store(raw)) == media.payload_of(raw)


def test_bad_streams():
    good = media.store(b"hello world, this is text")
    for bad in (b"", b"RIFF", good[:20], good[:-30], b"XXXX" + good[4:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)
    assert Bits(b"\xb4").read(4) == 4 and Sink().n == 0


def test_table_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "héé" * 1000, None), (3, "same", None), (4, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.read_pixels(media.stored_table(docs)).orderBy("doc_id").collect()
    assert len(out) == 6 and out[0].pixels == b"\0" * 64 and [r for r in out if r.doc_id == 2][0].pixels == media.payload_of(("héé" * 1000).encode())
    a, b = [r for r in out if r.doc_id in (3, 4)]
    assert a.media == b.media and a.feature == b.feature
    assert media.read_pixels(media.stored_table(docs.limit(0))).count() == 0


def test_all_near_distances():
    """Fixed values of the published format: the pairs of the 120 near distance codes, in order."""
    published = [
        (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
        (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
        (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
        (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
        (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
        (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
    ]
    assert NEAR == published


def test_predictions_and_colours_by_hand():
    """Values worked out from the published rules, not by the code that encodes: left, top, top right and top left of
    the channels (255, 10, 200, 30), (255, 20, 100, 31), (255, 40, 7, 90), (255, 13, 250, 33)."""
    left, top, right, corner = (np.array(x, np.int16) for x in ((255, 10, 200, 30), (255, 20, 100, 31), (255, 40, 7, 90), (255, 13, 250, 33)))
    want = {
        0: (255, 0, 0, 0), 1: (255, 10, 200, 30), 2: (255, 20, 100, 31), 3: (255, 40, 7, 90), 4: (255, 13, 250, 33),
        5: (255, 22, 101, 45), 6: (255, 11, 225, 31), 7: (255, 15, 150, 30), 8: (255, 16, 175, 32), 9: (255, 30, 53, 60),
        10: (255, 20, 139, 45), 11: (255, 20, 100, 31), 12: (255, 17, 50, 28), 13: (255, 16, 100, 29),
    }
    for mode, pixel in want.items():
        assert tuple(int(x) for x in webp.predict(mode, left, top, right, corner)) == pixel, mode
    # green 0x90 is -112; green to red 0x20 (32): -112; green to blue 0xF0 (-16): 56; red to blue 0x40 (64) of the new red
    pixel, factor = np.array([0xFF309005], np.uint32), np.array([0xFF40F020], np.uint32)
    red = (0x30 - 112) & 255  # 0xC0, as a signed byte -64
    blue = (0x05 + 56 + (64 * -64 >> 5)) & 255
    got = cross_colour(pixel, 1, 1, 2, factor, 1)
    assert int(got[0]) == 0xFF000000 | red << 16 | 0x90 << 8 | blue
    image = np.array([0xFF010203, 0x00010101, 0x00050505, 0x00020304], np.uint32)  # two by two, differences; mode 2 is the top
    out = webp.invert_predictor(image, 2, 2, 2, np.array([0xFF000200], np.uint32))
    assert [hex(int(x)) for x in out] == ["0xfe010203", "0xfe020304", "0xfe060708", "0xfe040608"]
