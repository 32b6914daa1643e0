"""A codec for lossless WebP (VP8L): a complete decoder and a writer for 8-bit sample planes.

The decoder reads simple and normal prefix codes, code groups chosen by an entropy image, back-references with
the short-distance map, the colour cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms. Where one group's red, blue and alpha are constant and there is no cache, its pixels are
read with array operations; otherwise symbol by symbol.

``encode_samples`` stores bytes as the green channel of images of 64 samples in a row: repeats become back-references,
literals, lengths and distances get prefix codes made of their own counts. Payloads of more than ``MAX_ROWS`` rows become
several images, one after the other. Such pixel data is read by array operations too: what each place of the bit stream
would decode to is looked up at once, then the true places are walked. ``encode_many`` and ``decode_many`` do this for many
payloads together: one set of array operations writes them, and a step of the reader takes a symbol of each image.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

WIDTH, MAX_ROWS = 64, 16384
SIGNATURE = 0x2F
#: Bytes of a bit stream that are looked up at once; repeats of fewer samples stay literals; bits of the longest codes.
STRIDE, LEAST_REPEAT, MOST_BITS = 1 << 15, 6, 11
LONGEST, FARTHEST = 4096, (1 << 20) - 120
#: Symbols of each image between two looks at which images are left; the fewest images read together; zeros after them.
BLOCK, FEW, AHEAD = 16, 48, 256
#: Samples that are written in one go, single images aside.
GROUP = 1 << 18
# Fixed values of the format: order of code-length codes, alphabet sizes.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
GREEN_SIZE, CHANNEL_SIZE, DISTANCE_SIZE = 256 + 24, 256, 40


# Fixed values of the format: the neighbours (dx, dy) that the short distances 1 to 120 stand for.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class Bits:
    """Least-significant-bit-first reader."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        at, shift = divmod(self.pos, 8)
        word = int.from_bytes(self.data[at : at + (shift + n + 7) // 8], "little")
        self.pos += n
        if self.pos > self.end:
            raise ValueError("the image data ends early")
        return (word >> shift) & ((1 << n) - 1)

    def ahead(self, n: int) -> int:
        """The next ``n`` bits or more, which stay to be read; zeros from the end on."""
        return int.from_bytes(self.data[self.pos >> 3 : (self.pos + n >> 3) + 1], "little") >> (self.pos & 7)

    def peek15(self) -> int:
        at, shift = divmod(self.pos, 8)
        return (int.from_bytes(self.data[at : at + 3], "little") >> shift) & 0x7FFF


def _reverse(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


@functools.lru_cache(maxsize=16)
def _backwards(n: int) -> np.ndarray:
    """Of each number of ``n`` bits the one with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out + (1 << (n - 1 - k))])
    return out


@functools.lru_cache(maxsize=4096)
def _short_code(lengths: tuple[int, ...]) -> tuple[list[int], list[int], int]:
    """Of a code of few symbols: table over the next bits (symbol and, in four bits, its length), each symbol's code, mask."""
    order = sorted([n << 12 | s for s, n in enumerate(lengths) if n])
    codes = [0] * len(lengths)
    if len(order) < 2:
        return [(order[0] & 0xFFF) << 4 if order else 0], codes, 0
    bits, at = order[-1] >> 12, 0
    table, back = [0] * (1 << bits), _backwards(bits)
    for x in order:
        n, s = x >> 12, x & 0xFFF
        if at >= 1 << bits:
            raise ValueError("a prefix code is not complete")
        codes[s] = int(back[at])
        table[codes[s] :: 1 << n] = [s << 4 | n] * (1 << bits - n)
        at += 1 << bits - n
    if at != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return table, codes, (1 << bits) - 1


class Code:
    """A canonical prefix code as a table over the next bits."""

    def __init__(self, lengths: list[int]):
        self.lengths, self.uniform = lengths, set(lengths) - {0}
        order = sorted([n << 12 | s for s, n in enumerate(lengths) if n])  # by length, then symbol
        self.only = None if len(order) > 1 else order[0] & 0xFFF if order else 0
        if self.only is not None:
            return
        order = np.array(order, np.int64)
        sizes = order >> 12
        self.bits = int(sizes[-1])
        room = 1 << (self.bits - sizes)
        if int(room.sum()) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        self.both = ((order & 0xFFF) << 4 | sizes).repeat(room)[_backwards(self.bits)]  # symbol and, in four bits, its length
        self.mask = (1 << self.bits) - 1
        self.list = None

    def next(self, b: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.list is None:
            self.list = self.both.tolist()
        found = self.list[b.peek15() & self.mask]
        b.pos += found & 15
        if b.pos > b.end:
            raise ValueError("the image data ends early")
        return found >> 4


@functools.lru_cache(maxsize=1024)
def _simple(size: int, *symbols: int) -> Code:
    """The code of one or two symbols."""
    lengths = [0] * size
    for s in symbols:
        lengths[s] = 1
    return Code(lengths)


#: Of the symbols for runs of code lengths the further bits and the shortest run.
_RUNS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}


def _read_code(b: Bits, size: int) -> Code:
    if b.read(1):  # simple: one or two symbols
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        return _simple(size, first, b.read(8)) if two else _simple(size, first)
    kinds, n = [0] * 19, 4 + b.read(4)
    word = b.read(3 * n)
    for k in CODE_LENGTH_ORDER[:n]:
        kinds[k] = word & 7
        word >>= 3
    both, _, mask = _short_code(tuple(kinds))
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    lengths: list[int] = []
    last, n = 8, 0
    word = b.ahead(14 * size)  # a length takes seven bits and up to seven more
    while len(lengths) < size and most:
        most -= 1
        s = both[word & mask]
        s, n = s >> 4, s & 15
        word >>= n
        b.pos += n
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            more, base = _RUNS[s]
            lengths += [last if s == 16 else 0] * (base + (word & (1 << more) - 1))
            word >>= more
            b.pos += more
    if b.pos > b.end:
        raise ValueError("the image data ends early")
    if len(lengths) > size:
        raise ValueError("a run of code lengths is too long")
    return Code(lengths + [0] * (size - len(lengths)))


_KNOWN: dict[tuple[int, ...], list[tuple[int, int, list[Code]]]] = {}


def _read_group(b: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """The five codes of a group; one that was read before is known again by its bits."""
    known = _KNOWN.setdefault(sizes, [])
    at, left = b.pos, b.end - b.pos
    word = b.ahead(max((n for n, _, _ in known), default=0))
    for n, bits, codes in known:
        if n <= left and word & (1 << n) - 1 == bits:
            b.pos += n
            return codes
    codes = [_read_code(b, n) for n in sizes]
    n, b.pos = b.pos - at, at
    known.insert(0, (n, b.read(n), codes))
    del known[8:]
    return codes


def _extended(b: Bits, s: int) -> int:
    """A length or distance from its prefix symbol."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + b.read(extra) + 1


def _image(b: Bits, w: int, h: int, top: bool) -> np.ndarray:
    """One entropy-coded image as an array of w*h ARGB values; only the top one may have an entropy image."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, which, block = 1, None, 0
    if top and b.read(1):
        block = b.read(3) + 2
        bw = (w + (1 << block) - 1) >> block
        bh = (h + (1 << block) - 1) >> block
        which = (_image(b, bw, bh, False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
        which = which.tolist()
    sizes = (GREEN_SIZE + (1 << cache_bits if cache_bits else 0), CHANNEL_SIZE, CHANNEL_SIZE, CHANNEL_SIZE, DISTANCE_SIZE)
    codes = [_read_group(b, sizes) for _ in range(groups)]
    if which is None and _plain(codes[0]):
        return _read_plain(b, w * h, codes[0])
    if which is None and not cache_bits and all(c.only is not None for c in codes[0][1:4]) and codes[0][0].only is None:
        return _read_green(b, w, w * h, codes[0])
    out = [0] * (w * h)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    at, shift = 0, 32 - cache_bits
    bw = (w + (1 << block) - 1) >> block if which is not None else 0
    kept = 0  # pixels that are in the cache
    while at < w * h:
        g = codes[which[(at // w >> block) * bw + (at % w >> block)]] if which is not None else codes[0]
        s = g[0].next(b)
        if s < 256:
            red = g[1].next(b)
            blue = g[2].next(b)
            out[at] = g[3].next(b) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < GREEN_SIZE:
            n = _extended(b, s - 256)
            d = _extended(b, g[4].next(b))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * w)
            if d > at or at + n > w * h:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            while kept < at:
                cache[(0x1E35A7BD * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out[at] = cache[s - GREEN_SIZE]
            at += 1
    return np.array(out, np.uint32)


def _plain(g: list[Code]) -> bool:
    """Whether array operations can read the pixels: constant red, blue, alpha and one length of literals."""
    return all(c.only is not None for c in g[1:4]) and (
        g[0].only is not None and g[0].only < 256
        or g[0].only is None and len(g[0].uniform) == 1 and not any(g[0].lengths[256:]) and g[0].bits == 8
    )


def _read_plain(b: Bits, n: int, g: list[Code]) -> np.ndarray:
    rest = np.uint32(g[3].only << 24 | g[1].only << 16 | g[2].only)
    if g[0].only is not None:
        return np.full(n, rest | np.uint32(g[0].only << 8), np.uint32)
    at, shift = divmod(b.pos, 8)
    b.pos += 8 * n
    if b.pos > b.end:
        raise ValueError("the image data ends early")
    raw = np.frombuffer(b.data, np.uint8, n + 1 if shift else n, at).astype(np.uint16)
    if shift:
        raw = (raw[:-1] >> shift | raw[1:] << (8 - shift)) & 255
    return (g[0].both[raw] >> 4).astype(np.uint32) << 8 | rest


@functools.lru_cache(maxsize=64)
def _near(w: int) -> np.ndarray:
    """The distances in pixels that the short distances 0 (unused) to 120 stand for."""
    return np.array([0, *(max(1, dx + dy * w) for dx, dy in NEAR)], np.int64)


def _values(words: np.ndarray, at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the bits at ``at``; how many bits each takes."""
    extra = np.maximum(s - 2, 0) >> 1
    bits = (words[at >> 3] >> (at & 7)) & ((1 << extra) - 1)
    return np.where(s < 4, s, ((2 + (s & 1)) << extra) + bits) + 1, extra


def _fill(out: bytearray, at: int, w: int, taken: np.ndarray, copies: np.ndarray, length: np.ndarray, distance: np.ndarray) -> tuple[int, int]:
    """Write symbols from pixel ``at`` on; those at ``copies`` are back-references. The pixel and symbol where this ends.

    Symbols after the last pixel are no pixels.
    """
    n = len(out)
    sizes = np.ones(len(taken), np.int64)
    sizes[copies] = length
    ends = at + sizes.cumsum()
    last = int(ends.searchsorted(n))
    if last < len(ends):
        if ends[last] > n:
            raise ValueError("a back-reference leaves the image")
        taken, ends = taken[: last + 1], ends[: last + 1]
        some = int(copies.searchsorted(last, "right"))
        copies, length, distance = copies[:some], length[:some], distance[:some]
    np.frombuffer(out, np.uint8)[ends - 1] = taken  # of a back-reference any value, as it is written next
    starts = ends[copies] - length
    d = np.where(distance > 120, distance - 120, _near(w)[np.minimum(distance, 120)])
    if (d > starts).any():
        raise ValueError("a back-reference leaves the image")
    for k, m, back in zip(starts.tolist(), length.tolist(), d.tolist(), strict=True):
        if back >= m:
            out[k : k + m] = out[k - back : k - back + m]
        else:
            out[k : k + m] = (out[k - back : k] * (m // back + 1))[:m]
    return int(ends[-1]) if len(ends) else at, len(ends)


def _read_green(b: Bits, w: int, n: int, g: list[Code], out: bytearray | None = None, at: int = 0) -> np.ndarray:
    """Pixels of one group whose red, blue and alpha are constant: literals and back-references of green.

    ``out`` has those before ``at``, where some were read before.
    """
    green, far = g[0], g[4]
    both = green.both
    out = bytearray(n) if out is None else out
    while at < n:
        if b.pos >= b.end:
            raise ValueError("the image data ends early")
        base, span = b.pos >> 3, min(STRIDE, (b.end + 7 >> 3) - (b.pos >> 3))
        raw = np.zeros(span + 16, np.int64)
        some = np.frombuffer(b.data, np.uint8, min(span + 16, len(b.data) - base), base)
        raw[: len(some)] = some
        words = raw[:-5] | raw[1:-4] << 8 | raw[2:-3] << 16 | raw[3:-2] << 24 | raw[4:-1] << 32  # from each byte on, 40 bits
        index = ((words[:span].astype(np.int32)[:, None] >> np.arange(8, dtype=np.int32)) & green.mask).reshape(-1)
        found = both[index.astype(np.int64)]  # 64 bits: numpy looks up other indices at twice the time
        after = (found & 15) + np.arange(8 * span)
        copies = np.flatnonzero(found >= 256 << 4)
        place = after[copies]
        length, extra = _values(words, place, (found[copies] >> 4) - 256)
        place = place + extra
        if far.only is None:
            s = far.both[(words[place >> 3] >> (place & 7)) & far.mask]
            s, place = s >> 4, place + (s & 15)
        else:
            s = np.full(len(copies), far.only, np.int64)
        # A distance has up to 18 bits more; these lie in the next five bytes of the place.
        distance, extra = _values(words, np.minimum(place, 8 * len(words) - 1), s)
        after[copies] = place + extra
        # The walk takes four symbols at a time; places from ``stop`` on stay where they are.
        stop = min(8 * span, b.end - 8 * base)
        after = np.concatenate([after[:stop], np.arange(stop, stop + 64)])
        two = after[after]
        steps, p, walked = memoryview(two[two]), b.pos & 7, []
        while p < stop:
            walked.append(p)
            p = steps[p]
        walked = np.array(walked, np.int64)
        walked = np.stack([walked, after[walked], two[walked], after[two[walked]]], 1).reshape(-1)
        walked = walked[walked < stop]
        taken = found[walked] >> 4
        is_copy = np.flatnonzero(taken >= 256)
        which = np.searchsorted(copies, walked[is_copy])
        at, some = _fill(out, at, w, taken.astype(np.uint8), is_copy, length[which], distance[which])
        if at == n:
            p = int(after[walked[some - 1]])
        if 8 * base + p > b.end:
            raise ValueError("the image data ends early")
        b.pos = 8 * base + p
    rest = np.uint32(g[3].only << 24 | g[1].only << 16 | g[2].only)
    return np.frombuffer(out, np.uint8).astype(np.uint32) << 8 | rest


def _read_greens(images: list[tuple[Bits, int, int, list[Code]]]) -> list[np.ndarray]:
    """Green samples of many images as ``_read_green`` reads them, a symbol of each image in one step.

    A distance's symbol is a step of its own, where its image reads through another code. Further bits are stepped over and
    taken for all images at once. Images that are left when there are fewer than ``FEW`` are read on one by one.
    """
    starts = 8 * np.cumsum([0, *(len(b.data) for b, *_ in images)])
    raw = b"".join([*(b.data for b, *_ in images), bytes(AHEAD)])
    words = np.ascontiguousarray(np.ndarray((len(raw) - 8,), "<i8", raw, strides=(1,)))  # from each byte on, 64 bits
    tables, known, size = [], {}, 0
    base, mask = np.zeros((2, len(images)), np.int64), np.zeros((2, len(images)), np.int64)  # of greens and of distances
    for k, (*_, g) in enumerate(images):
        for far, c in enumerate((g[0], g[4])):
            if id(c) not in known:
                both = c.both if c.only is None else np.array([c.only << 4], np.int64)
                s = np.maximum((both >> 4) - (0 if far else 256), 0)
                known[id(c)] = size
                tables.append((both >> 4 << 6) + (both & 15) + (np.maximum(s - 2, 0) >> 1) + (512 << 6 if far else 0))
                size += len(both)
            base[far, k], mask[far, k] = known[id(c)], c.mask if c.only is None else 0
    table = np.concatenate(tables)  # symbol, 512 more for distances; in six bits all bits that it takes
    n = np.array([x[2] for x in images], np.int64)
    most = n + (n >> 3)
    room = np.cumsum([0, *(most + BLOCK)])  # where each image's symbols lie
    symbols, behind = np.full(int(room[-1]) + 1, -1, np.int16), np.zeros(int(room[-1]) + 1, np.int64)
    after = starts[:-1] + np.array([x[0].pos for x in images], np.int64)
    end = starts[:-1] + np.array([x[0].end for x in images], np.int64)
    left, step, far = np.arange(len(images)), 0, np.zeros(len(images), np.int64)
    while True:
        left = left[(after[left] < end[left]) & (step < most[left])]
        if len(left) < FEW:
            break
        p, at, green = after[left], room[left] + step, (base[0, left], mask[0, left])
        other, bits = (base[1, left], mask[1, left])
        these, few = base[far[left], left], mask[far[left], left]
        c = np.flatnonzero(far[left])
        found, places = np.empty((BLOCK, len(left)), np.int64), np.empty((BLOCK, len(left)), np.int64)
        for k in range(BLOCK):
            s = table[((words[p >> 3] >> (p & 7)) & few) + these]
            found[k] = s
            p += s & 63
            places[k] = p
            if len(c):
                these[c], few[c] = green[0][c], green[1][c]
            s >>= 14
            c = (s == 1).nonzero()[0]
            if len(c):
                these[c], few[c] = other[c], bits[c]
        far[left] = s == 1
        at = at[:, None] + np.arange(BLOCK)
        symbols[at], behind[at] = (found >> 6).T, places.T
        after[left] = p
        step += BLOCK
    copies = np.flatnonzero(symbols >> 8 == 1)
    whole = symbols[copies + 1] >= 512
    symbols[copies[~whole]] = -1
    copies = copies[whole]
    values = []
    for more, s in ((0, symbols[copies].astype(np.int64) - 256), (1, symbols[copies + 1].astype(np.int64) - 512)):
        values.append(_values(words, behind[copies + more] - (np.maximum(s - 2, 0) >> 1), s)[0])
    length, distance = values
    behind[copies] = behind[copies + 1]
    kept = np.flatnonzero((symbols >= 0) & (symbols < 512))
    symbols, behind, copies = symbols[kept].astype(np.uint8), behind[kept], np.searchsorted(kept, copies)
    room = np.searchsorted(kept, room)
    of, out = np.searchsorted(copies, room).tolist(), []
    room = room.tolist()
    for k, (b, w, m, g) in enumerate(images):
        made, some, here = bytearray(m), slice(of[k], of[k + 1]), room[k]
        at, count = _fill(made, 0, w, symbols[here : room[k + 1]], copies[some] - here, length[some], distance[some])
        if count:
            b.pos = int(behind[here + count - 1] - starts[k])
        if b.pos > b.end:
            raise ValueError("the image data ends early")
        if at < m:
            _read_green(b, w, m, g, made, at)
        out.append(np.frombuffer(made, np.uint8))
    return out


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) & 255


def _predict(pixels: np.ndarray, w: int, h: int, bits: int, modes: np.ndarray) -> np.ndarray:
    """Invert the predictor transform: each pixel is its residual plus a guess from its neighbours."""
    px = np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32).reshape(h, w, 4)
    bw = (w + (1 << bits) - 1) >> bits
    modes = ((modes >> 8) & 15).reshape(-1, bw)
    avg = lambda a, c: (a + c) >> 1
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = px[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = px[y - 1, 0]
            else:
                left, top, corner = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                right = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
                m = modes[y >> bits, x >> bits]
                if m == 0 or m > 13:
                    guess = np.array([255, 0, 0, 0])
                elif m <= 4:
                    guess = (left, top, right, corner)[m - 1]
                elif m == 5:
                    guess = avg(avg(left, right), top)
                elif m <= 9:
                    guess = avg(*((left, corner), (left, top), (corner, top), (top, right))[m - 6])
                elif m == 10:
                    guess = avg(avg(left, corner), avg(top, right))
                elif m == 11:
                    by_left, by_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
                    guess = left if by_left < by_top else top
                elif m == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                else:
                    mid = avg(left, top)
                    diff = mid - corner
                    guess = np.clip(mid + np.trunc(diff / 2).astype(np.int32), 0, 255)
            px[y, x] = _add(px[y, x], guess)
    p = px.astype(np.uint32).reshape(-1, 4)
    return p[:, 0] << 24 | p[:, 1] << 16 | p[:, 2] << 8 | p[:, 3]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).astype(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, w: int, h: int, bits: int, factors: np.ndarray) -> np.ndarray:
    """Invert the cross-colour transform: add what green says of red, and green and red of blue."""
    bw = (w + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(w * h), w)
    f = factors[(y >> bits) * bw + (x >> bits)].astype(np.int64)
    p = pixels.astype(np.int64)
    green = _signed(p >> 8)
    red = ((p >> 16 & 255) + (_signed(f) * green >> 5)) & 255
    blue = ((p & 255) + (_signed(f >> 8) * green >> 5) + (_signed(f >> 16) * _signed(red) >> 5)) & 255
    return ((p & 0xFF00FF00) | red << 16 | blue).astype(np.uint32)


def _palette(pixels: np.ndarray, w: int, h: int, colours: np.ndarray, pack: int) -> np.ndarray:
    """Invert the palette transform: unpack indices from the green channel and look them up."""
    index = (pixels >> 8 & 255).astype(np.int64).reshape(h, -1)
    if pack:
        each, width = 1 << pack, 8 >> pack
        index = np.stack([index >> width * k & (1 << width) - 1 for k in range(each)], -1).reshape(h, -1)[:, :w]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index.reshape(-1)]


def _open(data: bytes) -> tuple[Bits, int]:
    """A reader of the first image's data, and the bytes that the image takes."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP image")
    total, size = struct.unpack("<I", data[4:8])[0] + 8, struct.unpack("<I", data[16:20])[0]
    return Bits(data[20 : 20 + size]), total + (total & 1)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The first image in ``data`` as an array (height, width) of ARGB values, and the bytes it took."""
    b, total = _open(data)
    if b.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP image")
    w, h = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    undo, xsize, seen = [], w, set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            bits = b.read(3) + 2
            side = _image(b, (xsize + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits, False)
            undo.append((kind, xsize, bits, side))
        elif kind == 2:
            undo.append((2, xsize, 0, None))
        else:
            n = b.read(8) + 1
            table = _image(b, n, 1, False)
            steps = np.stack([table >> s & 255 for s in (24, 16, 8, 0)])
            sums = np.cumsum(steps.astype(np.uint64), 1).astype(np.uint32) & 255
            colours = sums[0] << 24 | sums[1] << 16 | sums[2] << 8 | sums[3]
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, xsize, pack, colours))
            xsize = (xsize + (1 << pack) - 1) >> pack
    px = _image(b, xsize, h, True)
    for kind, width, bits, side in reversed(undo):
        if kind == 0:
            px = _predict(px, width, h, bits, side)
        elif kind == 1:
            px = _cross(px, width, h, bits, side)
        elif kind == 2:
            green = px >> 8 & 255
            px = px & 0xFF00FF00 | ((px >> 16 & 255) + green & 255) << 16 | (px + green & 255)
        else:
            px = _palette(px, width, h, side, bits)
    return px.reshape(h, w), total


class Writer:
    """Least-significant-bit-first writer."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: np.ndarray, most: int) -> list[int]:
    """Lengths of a prefix code for these counts, none above ``most``; small counts are raised until that holds."""
    used = np.flatnonzero(counts)
    lengths, m, floor = [0] * len(counts), len(used), 1
    if m == 1:
        lengths[used[0]] = 1
    while m > 1:
        weights = np.maximum(counts[used], floor)
        order = np.argsort(weights, kind="stable")
        weights = [*weights[order].tolist(), *[0] * (m - 1)]
        above, leaf, inner = [0] * (2 * m - 1), 0, m
        for k in range(m, 2 * m - 1):  # the two lightest of the leaves and of the inner nodes, which are in order too
            if leaf < m and (inner >= k or weights[leaf] <= weights[inner]):
                one, leaf = leaf, leaf + 1
            else:
                one, inner = inner, inner + 1
            if leaf < m and (inner >= k or weights[leaf] <= weights[inner]):
                two, leaf = leaf, leaf + 1
            else:
                two, inner = inner, inner + 1
            weights[k] = weights[one] + weights[two]
            above[one] = above[two] = k
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= most:
            for k, symbol in enumerate(used[order].tolist()):
                lengths[symbol] = depth[k]
            break
        floor *= 2
    return lengths


def _codes(lengths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each code's symbols, in one array, the codes as they are written and their bits: none in codes of one symbol."""
    sizes = np.array(lengths, np.int64)
    sizes[np.count_nonzero(sizes, 1) < 2] = 0
    width, sizes = sizes.shape[1], sizes.reshape(-1)
    codes = np.zeros(len(sizes), np.int64)
    used = np.flatnonzero(sizes)
    used = used[np.argsort((used // width << 4) + sizes[used], kind="stable")]  # by code, length, symbol
    room = 1 << (15 - sizes[used])  # of each code 2^15 in all
    codes[used] = _backwards(15)[(np.cumsum(room) - room) & 0x7FFF]
    return codes, sizes


def _put_symbol(out: Writer, symbol: int) -> None:
    """Write a code of one symbol below 256, which takes no bits."""
    out.put(1 | (4 | symbol << 3 if symbol > 1 else symbol << 3), 11 if symbol > 1 else 4)


def _put_code(out: Writer, lengths: list[int]) -> None:
    """Write a code: one symbol below 256 as such, others by their lengths, runs of none in short."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        _put_symbol(out, used[0] if used else 0)
        return
    said, at = [], 0  # symbol, further bits, how many
    for s in [*used, len(lengths)]:
        while s - at >= 3:
            run = min(s - at, 138)
            said.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
        said += [(0, 0, 0)] * (s - at)
        if s < len(lengths):
            said.append((lengths[s], 0, 0))
        at = s + 1
    kinds = code_lengths(np.bincount([s for s, _, _ in said], minlength=19), 7)
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if kinds[s]))
    out.put(0, 1)
    out.put(n - 4, 4)
    out.put(sum(kinds[k] << 3 * i for i, k in enumerate(CODE_LENGTH_ORDER[:n])), 3 * n + 1)  # the last bit: all symbols
    codes, sizes = _short_code(tuple(kinds))[1], kinds if sum(map(bool, kinds)) > 1 else [0] * 19
    value = n = 0
    for s, more, bits in said:
        value |= (codes[s] | more << sizes[s]) << n
        n += sizes[s] + bits
    out.put(value, n)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, further bits and how many of them for lengths or distances."""
    x = values - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(extra, 0) & 1)), x & ((1 << extra) - 1), extra


def _repeats(data: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references, taken greedily from the left; ``images`` is where images begin and end.

    A place may refer to the last one of its image with the same four samples; while the distance stays, the repeat goes on.
    """
    n = len(data) - 3
    four = np.empty(n, np.uint64)
    for k in range(4):
        some = data[k : k + (n - k + 3) // 4 * 4].view("<u4")
        four[k::4] = some
    keys = four << 32
    keys |= np.arange(n, dtype=np.uint64)
    keys.sort()
    gap = (keys[1:] - keys[:-1]).view(np.int64)  # under 2^32 where the samples are the same: then the distance
    back = np.zeros(n + 1, np.int64)
    back[(keys[1:] & 0xFFFFFFFF).astype(np.int64)] = gap
    back[(back > FARTHEST) | (back > np.arange(n + 1) - images[:-1].repeat(images[1:] - images[:-1])[: n + 1])] = 0
    for k in range(1, 4):  # what begins there leaves its image
        back[images[1:-1] - k] = 0
    ends = np.flatnonzero(back[1:] != back[:-1]) + 1
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    long = (ends - begins + 3 >= LEAST_REPEAT) & (back[begins] > 0) if len(ends) else np.zeros(0, bool)
    begins, ends = begins[: len(ends)][long], ends[long]
    starts, lengths, free = [], [], 0
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        begin = max(begin, free)
        while end + 3 - begin >= LEAST_REPEAT:
            starts.append(begin)
            lengths.append(min(end + 3 - begin, LONGEST))
            begin = free = begin + lengths[-1]
    starts = np.array(starts, np.int64)
    return starts, np.array(lengths, np.int64), back[starts]


@functools.lru_cache(maxsize=1)
def _short() -> np.ndarray:
    """The short distances that stand for distances in pixels, 0 where none does."""
    near = np.zeros(WIDTH * 8, np.int64)
    near[_near(WIDTH)[:0:-1]] = np.arange(120, 0, -1)
    return near


def _stored(part: np.ndarray, images: np.ndarray) -> list[bytes]:
    """The data of images whose green samples these are, one after the other; ``images`` is where each begins and the last ends."""
    count = len(images) - 1
    starts, lengths, back = _repeats(part, images)
    near = _short()
    short = near[np.minimum(back, len(near) - 1)] * (back < len(near))
    size_symbol, size_more, size_bits = _prefixed(lengths)
    far_symbol, far_more, far_bits = _prefixed(np.where(short > 0, short, back + 120))
    covered = np.zeros(len(part) + 1, np.int64)
    covered[starts] += 1
    covered[starts + lengths] -= 1
    literal = np.cumsum(covered[:-1]) == 0
    symbols = part.astype(np.int64)
    symbols[starts] = 256 + size_symbol
    literal[starts] = True
    places = np.flatnonzero(literal)
    symbols = symbols[places]
    copies = np.searchsorted(places, starts)
    first = np.searchsorted(places, images)  # of each image the first symbol
    symbols += GREEN_SIZE * np.arange(count).repeat(first[1:] - first[:-1])
    far_symbol += DISTANCE_SIZE * (np.searchsorted(images, starts, "right") - 1)
    greens = [code_lengths(x, MOST_BITS) for x in np.bincount(symbols, minlength=count * GREEN_SIZE).reshape(count, -1)]
    fars = [code_lengths(x, MOST_BITS) for x in np.bincount(far_symbol, minlength=count * DISTANCE_SIZE).reshape(count, -1)]
    heads = []
    for k, (green, far) in enumerate(zip(greens, fars, strict=True)):
        out = Writer()
        out.put(SIGNATURE | WIDTH - 1 << 8 | (int(images[k + 1] - images[k]) // WIDTH - 1) << 22, 8 + 14 + 14 + 1 + 3 + 3)
        _put_code(out, green)
        for value in (0, 0, 255):  # red, blue, alpha: one symbol each
            _put_symbol(out, value)
        _put_code(out, far)
        heads.append(out)
    (codes, bits), (far_codes, far_sizes) = _codes(greens), _codes(fars)
    values, widths = codes[symbols], bits[symbols]
    for more, n in ((size_more, size_bits), (far_codes[far_symbol], far_sizes[far_symbol]), (far_more, far_bits)):
        values[copies] |= more << widths[copies]
        widths[copies] += n
    # Words of 64 bits: a value adds to the word where it begins, and what is over to the next; bits do not meet.
    ahead = np.array([x.n for x in heads])
    totals = ahead + np.add.reduceat(widths, first[:-1])
    words = np.cumsum([0, *((totals >> 6) + 2)])
    at = np.cumsum(widths) - widths
    at += (64 * words[:-1] + ahead - at[first[:-1]]).repeat(first[1:] - first[:-1])
    body = np.zeros(words[-1], np.uint64)
    for x, k in zip(heads, words.tolist(), strict=False):
        head = np.frombuffer(x.done() + b"\0" * (-(x.n + 7 >> 3) % 8), "<u8")
        body[k : k + len(head)] = head
    word, shift, values = at >> 6, (at & 63).astype(np.uint64), values.astype(np.uint64)
    begins = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins = np.concatenate([np.zeros(1, np.int64), begins])
    body[word[begins]] += np.add.reduceat(values << shift, begins)
    over = np.flatnonzero((at & 63) + widths > 64)
    body[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    body = body.astype("<u8").tobytes()
    return [body[8 * k : 8 * k + (n + 7 >> 3)] for k, n in zip(words.tolist(), totals.tolist(), strict=False)]


def encode_samples(payload: bytes) -> bytes:
    """Store bytes (a multiple of 64 of them) as the green samples of one or more images."""
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """``encode_samples`` of each, where images are made together, in groups of at most ``GROUP`` samples or of one image."""
    if not all(payloads) or any(len(p) % WIDTH for p in payloads):
        raise ValueError("the payload must fill whole rows")
    pieces = [(k, at, min(WIDTH * MAX_ROWS, len(p) - at)) for k, p in enumerate(payloads) for at in range(0, len(p), WIDTH * MAX_ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    group, size = [], 0
    for piece in [*pieces, None]:
        if group and (piece is None or size + piece[2] > GROUP):
            part = np.frombuffer(b"".join(payloads[k][at : at + n] for k, at, n in group), np.uint8)
            stored = _stored(part, np.cumsum([0, *(n for _, _, n in group)]))
            for (k, _, _), data in zip(group, stored, strict=True):
                data += b"\0" * (len(data) & 1)
                out[k].append(b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data)
            group, size = [], 0
        if piece is not None:
            group.append(piece)
            size += piece[2]
    return [b"".join(x) for x in out]


def decode_samples(data: bytes) -> np.ndarray:
    """The green samples of all images in ``data``, in order."""
    parts, at, view = [], 0, memoryview(data)
    while at < len(data):
        px, n = decode(bytes(view[at:]) if at else data)
        parts.append((px >> 8 & 255).astype(np.uint8).reshape(-1))
        at += n
    return np.concatenate(parts)


#: What an image without transforms, colour cache and entropy image begins with, sides and the alpha flag aside.
_HEAD = (1 << 42) - 1 ^ ((1 << 29) - 1) << 8
_SIZES = (GREEN_SIZE, CHANNEL_SIZE, CHANNEL_SIZE, CHANNEL_SIZE, DISTANCE_SIZE)


def decode_many(stored: list[bytes]) -> list[np.ndarray]:
    """``decode_samples`` of each, where images of green alone are read together."""
    images, made = [], []  # of each file its images: samples, or the number among those that are read together
    for data in stored:
        at, parts, view = 0, [], memoryview(data)
        while at < len(data):
            one = bytes(view[at:]) if at else data
            b, n = _open(one)
            word, g = b.ahead(42), None
            if word & _HEAD == SIGNATURE and b.end >= 43:
                b.pos = 43
                g = _read_group(b, _SIZES)
            if g and all(c.only is not None for c in g[1:4]) and g[0].only is None:
                w, h = (word >> 8 & 0x3FFF) + 1, (word >> 22 & 0x3FFF) + 1
                parts.append(len(images))
                images.append((b, w, w * h, g))
            else:
                parts.append((decode(one)[0] >> 8 & 255).astype(np.uint8).reshape(-1))
            at += n
        made.append(parts)
    samples = _read_greens(images) if images else []
    made = [[samples[x] if isinstance(x, int) else x for x in parts] for parts in made]
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in made]
