"""Lossless WebP (VP8L) by the published bit-stream specification: a full decoder and a small encoder.

The decoder reads prefix codes, back-references, the colour cache and meta prefix images, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Streams with one prefix-code group and no colour cache take a
vectorised path: the code length at every bit position comes from one table lookup, so only the walk is sequential.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
#: Our own code for short texts: letters by falling frequency, and how long a short text is.
TEXT_LETTERS, TEXT_CAPITALS, SHORT = " etaoinshrdlucmwfgypbvkjxqz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4096
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near distances: all (dx, dy) of the half plane in reach, nearest first; ties by |dx|, then to the left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


def _reverse_index(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for k in range(bits):
        out = np.concatenate([out, out + (1 << (bits - 1 - k))])
    return out


REVERSED = [_reverse_index(k) for k in range(16)]


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 5], "little") >> (p & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code as a lookup table: symbol and length for each window of `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbols, self.lengths = 0, used.astype(np.int32), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[order].astype(np.int64)
        self.bits = int(sizes[-1])
        if int((1 << (self.bits - sizes)).sum()) != 1 << self.bits:
            raise ValueError("incomplete or overfull prefix code")
        spread = 1 << (self.bits - sizes)
        self.symbols = np.repeat(order, spread).astype(np.int32)[REVERSED[self.bits]]
        self.lengths = np.repeat(sizes, spread).astype(np.uint8)[REVERSED[self.bits]]

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        p = bits.at
        w = (int.from_bytes(bits.data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7)) & ((1 << self.bits) - 1)
        bits.at = p + int(self.lengths[w])
        return int(self.symbols[w])


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    outer = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        outer[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = Code(outer)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                lengths[at : at + n] = before
            at += n
    return Code(lengths)


def prefix_value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _groups(bits: Bits, n: int, cache_bits: int) -> list[list[Code]]:
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    if n == 1 and not cache_bits:
        head, length, group = text_codes()[2:]
        p = bits.at
        if (int.from_bytes(bits.data[p >> 3 : (p + length + 7) >> 3], "little") >> (p & 7)) & ((1 << length) - 1) == head:
            bits.at += length
            return [group]
    return [[read_code(bits, s) for s in sizes] for _ in range(n)]


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if not 0 <= cache_bits <= 11:
        raise ValueError("colour cache too large")
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width // (1 << shift))
        image = read_pixels(bits, across, -(-height // (1 << shift)), False)
        meta = (image >> 8) & 0xFFFF
    groups = _groups(bits, int(meta.max()) + 1 if meta is not None else 1, cache_bits)
    if meta is None and not cache_bits:
        return _walk(bits, groups[0], width, width * height)
    out = [0] * (width * height)
    cache = [0] * (1 << cache_bits)
    at, cached = 0, 0
    while at < len(out):
        if meta is not None:
            group = groups[int(meta[((at // width) >> shift) * across + ((at % width) >> shift)])]
        else:
            group = groups[0]
        s = group[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < LITERALS + LENGTHS:
            n = prefix_value(s - LITERALS, bits)
            d = distance(prefix_value(group[4].read(bits), bits), width)
            if d > at or at + n > len(out):
                raise ValueError("back-reference outside the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            while cached < at:
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def _walk(bits: Bits, group: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels of one prefix-code group without a colour cache.

    From every bit position the next literal's position is known at once; eight steps are composed by gathers, so the
    sequential walk takes one step for eight pixels. Back-references, which stop the walk, are read one by one.
    """
    green, red, blue, alpha, far = group
    out = np.zeros(total, np.uint32)
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[start:].astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint32)])
    triple = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    windows = np.empty((len(triple), 8), np.uint16)
    for k in range(8):
        windows[:, k] = triple >> np.uint32(k)
    windows = windows.ravel()
    mask = np.uint16((1 << green.bits) - 1)
    last = len(windows) - 1
    places = np.arange(len(windows), dtype=np.int32)
    literal = green.symbols < LITERALS
    step = places + green.lengths.astype(np.int32)[windows & mask]
    for c in (red, blue, alpha):
        if c.bits:
            np.minimum(step, last, out=step)
            step += c.lengths[windows[step] & np.uint16((1 << c.bits) - 1)]
    np.minimum(step, last, out=step)
    if not literal.all():
        step = np.where(literal[windows & mask], step, places)
    eight = step
    for _ in range(3):
        eight = eight[eight]

    def literals(where):
        w = windows[where] & mask
        value = green.symbols[w].astype(np.uint32) << np.uint32(8)
        end = where + green.lengths[w]
        for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if c.bits:
                w = windows[end] & np.uint16((1 << c.bits) - 1)
                value |= c.symbols[w].astype(np.uint32) << np.uint32(shift)
                end = end + c.lengths[w]
            else:
                value |= np.uint32(int(c.symbols[0]) << shift)
        return value

    jumps = memoryview(eight)
    at, p = 0, bits.at - 8 * start
    no_bits = not (green.bits or red.bits or blue.bits or alpha.bits) and bool(literal[0])
    while at < total:
        if no_bits:
            out[at:] = literals(np.array([p]))[0]
            break
        found = [p]
        for _ in range((total - at) >> 3):
            q = jumps[p]
            if q == p:
                break
            found.append(q)
            p = q
        ways = np.empty((len(found), 9), np.int32)
        ways[:, 0] = found
        for k in range(8):
            ways[:, k + 1] = step[ways[:, k]]
        ways = np.append(ways[:, :8].ravel(), ways[-1, 8])
        n = min(total - at, len(ways) - 1)
        stops = np.flatnonzero(ways[1 : n + 1] == ways[:n])
        n = int(stops[0]) if len(stops) else n
        if n:
            out[at : at + n] = literals(ways[:n])
            at += n
        p = int(ways[n])
        if p >= last - 16 and at < total:
            raise ValueError("stream too short")
        if at < total and not literal[windows[p] & mask]:
            bits.at = p + 8 * start
            s = green.read(bits)
            n = prefix_value(s - LITERALS, bits)
            d = distance(prefix_value(far.read(bits), bits), width)
            if d > at or at + n > total:
                raise ValueError("back-reference outside the image")
            out[at : at + n] = out[at - d : at - d + n] if d >= n else np.resize(out[at - d : at], n)
            at += n
            p = bits.at - 8 * start
    bits.at = p + 8 * start
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB to int16 columns A, R, G, B."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int16)


def _pack(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, top, right, corner):
    """The predicted pixel(s) of a mode from int16 channel values: left, top, top right, top left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        gap = mean - corner
        return np.clip(mean + np.where(gap < 0, -(-gap >> 1), gap >> 1), 0, 255)
    return np.array([255, 0, 0, 0], np.int16)


def predicted(image: np.ndarray, x: int, y: int, mode: int) -> np.ndarray:
    """The prediction at one place of an (h, w, 4) image; the first row and column have rules of their own."""
    if y == 0:
        return image[0, x - 1] if x else np.array([255, 0, 0, 0], np.int16)
    if x == 0:
        return image[y - 1, 0]
    right = image[y - 1, x + 1] if x + 1 < image.shape[1] else image[y, 0]
    return predict(mode, image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1])


def invert_predictor(pixels: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray) -> np.ndarray:
    image = _channels(pixels).reshape(height, width, 4)
    across = -(-width // (1 << shift))
    modes = ((modes >> np.uint32(8)) & np.uint32(15)).reshape(-1, across)
    image[0, 0] += np.array([255, 0, 0, 0], np.int16)
    image[0] = np.cumsum(image[0], 0, dtype=np.int64) & 255
    for y in range(1, height):
        image[y, 0] = (image[y, 0] + image[y - 1, 0]) & 255
        above = np.concatenate([image[y - 1], image[y, :1]])
        for b in range(across):
            lo, hi, mode = max(1, b << shift), min(width, (b + 1) << shift), int(modes[y >> shift, b])
            if lo >= hi:
                continue
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):  # these don't look to the left
                image[y, lo:hi] = (image[y, lo:hi] + predict(mode, None, above[lo:hi], above[lo + 1 : hi + 1], above[lo - 1 : hi - 1])) & 255
            elif mode == 1:
                image[y, lo:hi] = np.cumsum(image[y, lo - 1 : hi], 0, dtype=np.int64)[1:] & 255
            else:
                for x in range(lo, hi):
                    image[y, x] = (image[y, x] + predict(mode, image[y, x - 1], above[x], above[x + 1], above[x - 1])) & 255
    return _pack(image).ravel()


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8)) >> 5


def cross_colour(pixels: np.ndarray, width: int, height: int, shift: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1: inverts the transform) or subtracts (sign -1: applies it) the cross-colour part."""
    image = _channels(pixels).reshape(height, width, 4)
    f = _channels(factors).reshape(-1, -(-width // (1 << shift)), 4)[np.arange(height)[:, None] >> shift, np.arange(width)[None] >> shift]
    green, old = image[..., 2], image[..., 1]
    red = (old + sign * _delta(f[..., 3], green)) & 255
    blue = image[..., 3] + sign * (_delta(f[..., 2], green) + _delta(f[..., 1], red if sign > 0 else old))
    image[..., 1], image[..., 3] = red, blue & 255
    return _pack(image).ravel()


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and uint32 ARGB pixels of a VP8L chunk's bytes."""
    if data[:1] != b"\x2f":
        raise ValueError("not a VP8L stream")
    bits = Bits(data)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    steps, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in steps):
            raise ValueError("a transform is repeated")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            steps.append((kind, now, shift, read_pixels(bits, -(-now // (1 << shift)), -(-height // (1 << shift)), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _pack(np.cumsum(_channels(read_pixels(bits, n, 1, False)), 0, dtype=np.int64))
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, now, shift, colours))
            now = -(-now // (1 << shift))
        else:
            steps.append((kind, now, 0, None))
    pixels = read_pixels(bits, now, height, True)
    for kind, wide, shift, more in reversed(steps):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, wide, height, shift, more)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, wide, height, shift, more, 1)
        elif kind == SUBTRACT_GREEN:
            green = (pixels >> np.uint32(8)) & np.uint32(255)
            odd = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
            pixels = (pixels & np.uint32(0xFF00FF00)) | (odd & np.uint32(0x00FF00FF))
        else:
            index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            if shift:
                each = 8 >> shift
                index = ((index[..., None] >> (np.arange(1 << shift, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(more)] = more
            pixels = table[index.ravel()]
    return width, height, pixels


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


# --- encoder ---------------------------------------------------------------------------------------------------------


class Sink:
    """Collects little-endian bits in one integer."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths, none above `most`: counts are flattened until they fit."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = [int(counts[k]) for k in used]
    while True:
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, fresh = {}, len(weight)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            parent[a[1]] = parent[b[1]] = fresh
            heapq.heapreplace(heap, (a[0] + b[0], fresh))
            fresh += 1
        depth = [0] * fresh
        for k in range(fresh - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weight)]) <= most:
            lengths[used] = depth[: len(weight)]
            return lengths
        weight = [(w + 1) // 2 + 1 for w in weight]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, ready for a little-endian stream; a lone symbol takes no bits."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    code = before = 0
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[s])
        code <<= n - before
        out[s] = int(REVERSED[n][code])
        code, before = code + 1, n
    return out


def write_code(sink: Sink, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        sink.put(1 | (s > 1) << 2, 3)
        sink.put(s, 8 if s > 1 else 1)
        return
    tokens, at, ls = [], 0, lengths.tolist()
    while at < len(ls):
        n = 1
        while at + n < len(ls) and ls[at + n] == ls[at] and n < 138:
            n += 1
        if ls[at] == 0 and n >= 3:
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        else:
            n = 1
            tokens.append((ls[at], 0, 0))
        at += n
    outer = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    last = max(k for k in range(19) if outer[CODE_LENGTH_ORDER[k]])
    sink.put(0, 1)
    sink.put(max(0, last - 3), 4)
    for k in range(max(4, last + 1)):
        sink.put(int(outer[CODE_LENGTH_ORDER[k]]), 3)
    sink.put(0, 1)
    codes, alone = codes_of(outer).tolist(), int((outer > 0).sum()) == 1
    for s, extra, n in tokens:
        sink.put(codes[s], 0 if alone else int(outer[s]))
        sink.put(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    x = value - 1
    high = x.bit_length() - 1
    return 2 * high + ((x >> (high - 1)) & 1), x & ((1 << (high - 1)) - 1), high - 1


def write_tokens(sink: Sink, tokens: list[tuple], cache_bits: int) -> None:
    """Prefix codes and data. A token is ('p', argb), ('c', cache index) or ('b', length, distance code)."""
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [np.zeros(s, np.int64) for s in sizes]
    parts = []
    for t in tokens:
        if t[0] == "p":
            row = [(0, t[1] >> 8 & 255), (1, t[1] >> 16 & 255), (2, t[1] & 255), (3, t[1] >> 24)]
        elif t[0] == "c":
            row = [(0, LITERALS + LENGTHS + t[1])]
        else:
            (a, ax, an), (b, bx, bn) = prefix_of(t[1]), prefix_of(t[2])
            row = [(0, LITERALS + a), (None, ax, an), (4, b), (None, bx, bn)]
        for x in row:
            if x[0] is not None:
                counts[x[0]][x[1]] += 1
        parts.append(row)
    lengths = [code_lengths(c, 15) for c in counts]
    for x in lengths:
        write_code(sink, x)
    codes = [codes_of(x) for x in lengths]
    alone = [int((x > 0).sum()) < 2 for x in lengths]
    for row in parts:
        for x in row:
            if x[0] is None:
                sink.put(x[1], x[2])
            elif not alone[x[0]]:
                sink.put(int(codes[x[0]][x[1]]), int(lengths[x[0]][x[1]]))


def wrap(stream: bytes) -> bytes:
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def _head(width: int, height: int) -> Sink:
    sink = Sink()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        sink.put(value, n)
    return sink


def write_grey_codes(sink: Sink, lengths: np.ndarray) -> None:
    """The five codes of a grey image: green as given; red and blue 0, alpha 255; distance code 2, the pixel to the left."""
    write_code(sink, lengths)
    for s in (0, 0, 255, 1):
        sink.put(1 | (s > 1) << 2, 3)
        sink.put(s, 8 if s > 1 else 1)


@functools.cache
def text_codes() -> tuple:
    """A code for short texts: lengths, codes, their bits in a stream and how many, and the codes as read back."""
    counts = np.ones(LITERALS + LENGTHS, np.int64)
    for text, weight in ((TEXT_CAPITALS, 4), ("0123456789", 4), ("\n.,", 12)):
        counts[list(text.encode())] = weight
    counts[0x80:0xC0], counts[0xC3] = 2, 20
    for k, c in enumerate(TEXT_LETTERS.encode()):
        counts[c] = 200 * 0.9**k
    lengths = code_lengths(counts, 15)
    sink = Sink()
    write_grey_codes(sink, lengths)
    bits = Bits(sink.value.to_bytes((sink.n + 7) // 8, "little"))
    group = [read_code(bits, n) for n in (LITERALS + LENGTHS, 256, 256, 256, DISTANCES)]
    return lengths, codes_of(lengths), sink.value, sink.n, group


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A WebP file whose R, G and B are the 8-bit samples: subtract-green leaves one coded channel.

    Up to `SHORT` samples take one fixed code, which costs less than describing a code of their own. A run of equal
    samples at the end becomes one back-reference.
    """
    samples = np.ascontiguousarray(samples, np.uint8)
    different = np.flatnonzero(samples != samples[-1])
    run = len(samples) - 1 - (int(different[-1]) + 1 if len(different) else 0)
    run = min(run, 4096) if run >= 4 else 0
    literal = samples[: len(samples) - run]
    symbol, extra, extra_bits = prefix_of(run) if run else (0, 0, 0)
    sink = _head(width, len(samples) // width)
    sink.put(1 | SUBTRACT_GREEN << 1, 3)
    sink.put(0, 3)  # no more transforms, no colour cache, no meta prefix image
    if len(samples) <= SHORT:
        lengths, codes, head, n, _ = text_codes()
        sink.put(head, n)
    else:
        counts = np.zeros(LITERALS + LENGTHS, np.int64)
        counts[:256] = np.bincount(literal, minlength=256)
        if run:
            counts[LITERALS + symbol] += 1
        lengths = code_lengths(counts, 15)
        write_grey_codes(sink, lengths)
        codes = codes_of(lengths)
        if (lengths > 0).sum() == 1:
            lengths = np.zeros_like(lengths)
    size = lengths[literal]
    ends = np.cumsum(size) + sink.n
    total = int(ends[-1]) + (int(lengths[LITERALS + symbol]) + extra_bits if run else 0)
    words = np.zeros((total >> 6) + 2, np.uint64)
    words |= np.frombuffer(sink.value.to_bytes(len(words) * 8, "little"), np.uint64)
    at = ends - size
    code, shift, word = codes[literal].astype(np.uint64), (at & 63).astype(np.uint64), at >> 6
    low = code << shift
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(low, first)
    over = np.flatnonzero((shift.astype(np.int64) + size) > 64)
    words[word[over] + 1] |= code[over] >> (np.uint64(64) - shift[over])
    if run:
        tail = (int(codes[LITERALS + symbol]) | extra << int(lengths[LITERALS + symbol])) << (int(ends[-1]) & 63)
        k = int(ends[-1]) >> 6
        words[k] |= np.uint64(tail & 0xFFFFFFFFFFFFFFFF)
        words[k + 1] |= np.uint64(tail >> 64)
    return wrap(words.tobytes()[: (total + 7) // 8])
