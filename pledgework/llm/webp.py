"""Lossless WebP: a decoder for whole batches of images, an encoder, and payload columns stored as images.

The decoder reads prefix codes, back-references, the colour cache and prefix-code groups, and inverts the
predictor, cross-colour, subtract-green and palette transforms. Every step of the format makes one pixel of
an image, so a batch is decoded in lock-step: one numpy step makes the next pixel of all images still open.

A payload of bytes becomes pixels of four bytes, ROW_BYTES to a row. Every payload is stored as frames of up to
FRAME_ROWS rows below each other (the format's animation chunks), so that no image is large. A frame is encoded with
each set of transforms that may help (none; a palette; prediction with cross-colour) and the shortest one is stored.

Defined cases: a null text is an empty payload, padded to one row; equal texts give equal files; rows that
repeat give equal values; an empty table gives no rows; further columns are ignored. A file that breaks the
format raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pledgework.llm.common import Columns, map_slices

ROW_BYTES = 576
FRAME_ROWS = 32
CACHE_BITS = 7
BATCH_BYTES = 8_000_000
#: The encoder's codes; short ones keep the decoder's tables small. With a cache of 11 bits they are longer.
LONGEST_CODE = 12
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The order in which lengths of the code-length code are stored, and the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
#: Offsets of short distance codes: nearest first, then the least sideways, then to the right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
NEAR_X, NEAR_Y = (np.array(v, np.int64) for v in zip(*NEAR))
_REVERSED: dict[int, np.ndarray] = {}
CHANNEL = 256 * np.arange(4)


def reversal(bits: int) -> np.ndarray:
    if bits not in _REVERSED:
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out |= (np.arange(1 << bits) >> i & 1) << (bits - 1 - i)
        _REVERSED[bits] = out
    return _REVERSED[bits]


# ---- prefix codes


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman lengths; counts are flattened until none is longer than most."""
    symbols = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    weights = counts[symbols].tolist()
    while True:
        # leaves by weight and inner nodes, which come by weight, are two queues; of equal weights the leaf comes first
        n = len(weights)
        leaves = sorted(range(n), key=weights.__getitem__)
        own = [weights[i] for i in leaves] + [1 << 62] * 2
        inner = [1 << 62] * (n + 1)
        parent = [0] * (2 * n - 1)
        i = j = 0
        for made in range(n - 1):
            if own[i] <= inner[j]:
                w, a, i = own[i], leaves[i], i + 1
            else:
                w, a, j = inner[j], n + j, j + 1
            if own[i] <= inner[j]:
                v, b, i = own[i], leaves[i], i + 1
            else:
                v, b, j = inner[j], n + j, j + 1
            parent[a] = parent[b] = n + made
            inner[made] = w + v
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            lengths[symbols] = depth[:n]
            return lengths
        least = max(1, sum(weights) >> (most - 2))
        weights = [max(w, least) for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, as they stand in the file."""
    used = lengths.nonzero()[0]
    codes = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return codes
    own = lengths[used]
    order = own.argsort(kind="stable")
    own = own[order]
    top = int(own[-1])
    steps = 1 << (top - own)
    codes[used[order]] = reversal(top)[steps.cumsum() - steps]
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): the next bits give symbol * 16 + length."""
    used = lengths.nonzero()[0]
    if len(used) == 0:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([used[0] * 16], np.int32), 0
    own = lengths[used]
    order = own.argsort(kind="stable")
    own = own[order]
    top = int(own[-1])
    table = (used[order] * 16 + own).astype(np.int32).repeat(1 << (top - own))
    if len(table) != 1 << top:
        raise ValueError("a prefix code that isn't complete")
    return table[reversal(top)], top


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        i = self.at >> 3
        value = int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the data end too early")
        return value

    def code(self, alphabet: int) -> tuple[np.ndarray, int]:
        """A prefix code's lookup table."""
        lengths = np.zeros(alphabet, np.int64)
        if self.read(1):
            n, wide = self.read(1) + 1, self.read(1)
            lengths[self.read(8 if wide else 1)] = 1
            if n == 2:
                lengths[self.read(8)] = 1
            return lookup(lengths)
        few, own = LENGTH_ORDER[: 4 + self.read(4)], [0] * 19
        packed = self.read(30) | self.read(3 * len(few) - 30) << 30 if len(few) > 10 else self.read(3 * len(few))
        for k in few:
            own[k], packed = packed & 7, packed >> 3
        table, bits = lookup(np.array(own, np.int64))
        table, mask = table.tolist(), (1 << bits) - 1
        left = alphabet
        if self.read(1):
            left = 2 + self.read(2 + 2 * self.read(3))
        at, before, data, pos, out = 0, 8, self.data, self.at, [0] * alphabet
        base, window = -1000, 0
        while at < alphabet and left:
            left -= 1
            if pos - base > 460:
                base = pos & ~7
                window = int.from_bytes(data[base >> 3 : (base >> 3) + 64], "little")
            bit = window >> (pos - base)
            entry = table[bit & mask]
            n, symbol = entry & 15, entry >> 4
            pos += n
            if symbol < 16:
                out[at] = symbol
                at += 1
                before = symbol or before
            else:
                more, least = ((2, 3), (3, 3), (7, 11))[symbol - 16]
                times = least + (bit >> n & (1 << more) - 1)
                pos += more
                if at + times > alphabet:
                    raise ValueError("code lengths beyond the alphabet")
                if symbol == 16:
                    out[at : at + times] = [before] * times
                at += times
        self.at = pos
        return lookup(np.array(out, np.int64))


# ---- decoding


class Job:
    """An image's pixel data: where its bits are, its codes by group, its cache and its map of groups."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.data, self.width, self.height, self.groups_at, self.group_bits = bits.data, width, height, None, 0
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache of over 11 bits")
        groups = 1
        if main and bits.read(1):
            self.group_bits = bits.read(3) + 2
            small = sub_image(bits, -(-width >> self.group_bits), -(-height >> self.group_bits))
            self.groups_at = (small >> 8 & 0xFFFF).astype(np.int64)
            groups = int(self.groups_at.max()) + 1
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.codes = []
        for _ in range(groups):
            made: list = []
            for size in sizes:
                if len(made) in (2, 3):  # often the same code again
                    a, b = made[-1][1]
                    if _same(bits.data, a, bits.at, b - a):
                        made.append((made[-1][0], (bits.at, bits.at + b - a)))
                        bits.at += b - a
                        continue
                a = bits.at
                made.append((bits.code(size), (a, bits.at)))
            self.codes.append([c for c, _ in made])
        self.start = bits.at


def _same(data: bytes, a: int, b: int, n: int) -> bool:
    def cut(at: int) -> int:
        return int.from_bytes(data[at >> 3 : (at + n >> 3) + 1], "little") >> (at & 7) & (1 << n) - 1

    return b + n <= 8 * len(data) and cut(a) == cut(b)


def sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    job = Job(bits, width, height, False)
    (pixels,), (bits.at,) = decode_pixels([job])
    return pixels.reshape(height, width)


def _value(window: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A length or distance of its prefix symbol and the bits that follow, and how many those are."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    low = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    return low + (window.view(np.int64) & ((1 << extra) - 1)) + 1, extra


def decode_pixels(jobs: list[Job]) -> tuple[list[np.ndarray], list[int]]:
    """The ARGB pixels of each job, and the bit where its data end. All jobs advance by one pixel a step."""
    order = sorted(range(len(jobs)), key=lambda k: -jobs[k].width * jobs[k].height)
    own = [jobs[k] for k in order]
    n = np.array([j.width * j.height for j in own], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(j.data) + 8 for j in own])[:-1])).astype(np.int64)
    data = bytearray(int(starts[-1]) + len(own[-1].data) + 16)
    for j, s in zip(own, starts.tolist()):
        data[s : s + len(j.data)] = j.data
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    pos = np.array([j.start for j in own], np.int64) + 8 * starts
    ends = 8 * (starts + np.array([len(j.data) for j in own], np.int64))
    first_group = np.concatenate(([0], np.cumsum([len(j.codes) for j in own])[:-1])).astype(np.int64)
    every = [c for j in own for c in j.codes]
    tables = {id(t): t for codes in every for t, _ in codes}
    starts_of = dict(zip(tables, np.concatenate(([0], np.cumsum([len(t) for t in tables.values()])[:-1])).tolist()))
    offsets = np.array([starts_of[id(t)] for codes in every for t, _ in codes], np.int64).reshape(-1, 5)
    masks = np.array([(1 << b) - 1 for codes in every for _, b in codes], np.int64).reshape(-1, 5)
    table = np.concatenate(list(tables.values())).astype(np.int64)  # one type for all of a step; views, not copies, where a shift needs unsigned
    out_at = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    out = np.zeros(int(n.sum()), np.uint32)
    cache_bits = np.array([j.cache_bits for j in own], np.int64)
    cache_at = np.concatenate(([0], np.cumsum([1 << j.cache_bits for j in own])[:-1])).astype(np.int64)
    cache = np.zeros(int(cache_at[-1]) + (1 << own[-1].cache_bits), np.uint32)
    any_cache, shifts = bool(cache_bits.any()), (32 - cache_bits).astype(np.uint32)
    widths = np.array([j.width for j in own], np.int64)
    mapped = [k for k, j in enumerate(own) if j.groups_at is not None]
    group = first_group.copy()
    left, back = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    copying, open_jobs = False, len(own)
    og, orr, ob, oa, od = offsets[group].T
    mg, mr, mb, ma, md = masks[group].T

    for t in range(int(n[0]) if len(n) else 0):
        while n[open_jobs - 1] <= t:
            open_jobs -= 1
        k = open_jobs
        if mapped:
            for i in mapped:
                if i < k:
                    j = own[i]
                    y, x = divmod(t, j.width)
                    group[i] = first_group[i] + j.groups_at[y >> j.group_bits, x >> j.group_bits]
            og, orr, ob, oa, od = offsets[group].T
            mg, mr, mb, ma, md = masks[group].T
        here = out_at[:k] + t
        fresh = (left[:k] == 0).nonzero()[0] if copying else None
        if fresh is None or len(fresh) == k:
            fresh, p, g, gm = None, pos[:k], og[:k], mg[:k]
        else:
            p, g, gm = pos[fresh], og[fresh], mg[fresh]
        if len(p):
            window = words[p >> 3] >> (p & 7).view(np.uint64)
            entry = table[g + (window.view(np.int64) & gm)]
            symbol, size = entry >> 4, entry & 15
            literal = symbol < 256
            if literal.all():
                which = fresh
            else:
                base = np.arange(k) if fresh is None else fresh
                which = base[literal]
                other, sym, win = base[~literal], symbol[~literal], (window >> size.view(np.uint64))[~literal]
                at = p[~literal] + size[~literal]
                run = sym < 280
                if run.any():
                    w = other[run]
                    count, extra = _value(win[run], sym[run] - 256)
                    q = at[run] + extra
                    win2 = words[q >> 3] >> (q & 7).view(np.uint64)
                    e = table[od[w] + (win2.view(np.int64) & md[w])]
                    bits = e & 15
                    code, extra = _value(win2 >> bits.view(np.uint64), e >> 4)
                    near = np.minimum(code, 120) - 1
                    dist = np.where(code > 120, code - 120, np.maximum(1, NEAR_X[near] + NEAR_Y[near] * widths[w]))
                    if (dist > t).any() or (count > n[w] - t).any():
                        raise ValueError("a back-reference outside the image")
                    at[run] = q + bits + extra
                    left[w], back[w] = count, dist
                    copying = True
                if not run.all():
                    w = other[~run]
                    out[here[w]] = cache[cache_at[w] + (sym[~run] - 280)]
                pos[other] = at
                if len(which):
                    window, symbol, size, p = window[literal], symbol[literal], size[literal], p[literal]
            if which is None or len(which):
                lr, lm = (orr[:k], mr[:k]) if which is None else (orr[which], mr[which])
                window = window >> size.view(np.uint64)
                e = table[lr + (window.view(np.int64) & lm)]
                red, bits = e >> 4, e & 15
                p = p + size + bits
                window = words[p >> 3] >> (p & 7).view(np.uint64)
                lb, lm = (ob[:k], mb[:k]) if which is None else (ob[which], mb[which])
                e = table[lb + (window.view(np.int64) & lm)]
                blue, bits = e >> 4, e & 15
                window = window >> bits.view(np.uint64)
                la, lm = (oa[:k], ma[:k]) if which is None else (oa[which], ma[which])
                e = table[la + (window.view(np.int64) & lm)]
                p = p + bits + (e & 15)
                pixel = ((e >> 4) << 24 | red << 16 | symbol << 8 | blue).astype(np.uint32)
                if which is None:
                    pos[:k], out[here] = p, pixel
                else:
                    pos[which], out[here[which]] = p, pixel
        if copying:
            w = left[:k].nonzero()[0]
            out[here[w]] = out[here[w] - back[w]]
            left[w] -= 1
            copying = bool(left.any())
        if any_cache:
            made = out[here]
            cache[cache_at[:k] + (made * np.uint32(CACHE_MULTIPLIER) >> shifts[:k])] = made  # a shift by 32 gives 0, the slot of those without
    if (pos > ends).any():
        raise ValueError("the data end too early")
    pixels, stops = [None] * len(jobs), [0] * len(jobs)
    for i, k in enumerate(order):
        pixels[k] = out[out_at[i] : out_at[i] + n[i]]
        stops[k] = int(pos[i] - 8 * starts[i])
    return pixels, stops


def channels(argb: np.ndarray) -> np.ndarray:
    """uint32 pixels to (..., 4) integers: alpha, red, green, blue."""
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(np.int64)


def pixels_of(ch: np.ndarray) -> np.ndarray:
    ch = (ch & 255).astype(np.uint32)
    return ch[..., 0] << 24 | ch[..., 1] << 16 | ch[..., 2] << 8 | ch[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of one pixel, by channels."""
    def mean(a, b):
        return (a + b) >> 1

    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - corner
        return np.clip(m + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top),
        8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def prediction_walk(ch: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Residues to pixels, or back. ch: (height, width, 4). Parts of a row whose mode looks at the row above only, or at the left only, are done at once."""
    h, w, _ = ch.shape
    whole, out = ch.copy(), ch.copy()  # pixels, residues
    for y in range(h):
        own = np.where(np.arange(w) == 0, 2 if y else 0, 1) if not y else np.concatenate(([2], modes[y >> bits, np.arange(1, w) >> bits]))
        if y:
            top = whole[y - 1]
            right, corner = np.concatenate((top[1:], whole[y, :1])), np.concatenate((top[:1], top[:-1]))
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), w]
        for a, b in zip(cuts, cuts[1:]):
            mode = int(own[a])
            if mode == 1 and not forward:
                whole[y, a:b] = np.cumsum(np.concatenate((whole[y, a - 1 : a], ch[y, a:b])), axis=0)[1:] & 255
                continue
            if mode in (1, 2, 4, 8) or mode == 3 and b < w or mode == 9 and b < w or mode in (0, 14, 15):
                above = {2: lambda: top[a:b], 3: lambda: right[a:b], 4: lambda: corner[a:b], 8: lambda: (corner[a:b] + top[a:b]) >> 1, 9: lambda: (top[a:b] + right[a:b]) >> 1, 1: lambda: whole[y, a - 1 : b - 1]}
                guess = above.get(mode, lambda: np.array([255, 0, 0, 0]))()
                if forward:
                    out[y, a:b] = (ch[y, a:b] - guess) & 255
                else:
                    whole[y, a:b] = (ch[y, a:b] + guess) & 255
                continue
            for x in range(a, b):
                after = whole[y - 1, x + 1] if x + 1 < w else whole[y, 0]
                guess = predict(mode, whole[y, x - 1], whole[y - 1, x], whole[y - 1, x - 1], after)
                if forward:
                    out[y, x] = (ch[y, x] - guess) & 255
                else:
                    whole[y, x] = (ch[y, x] + guess) & 255
    return out if forward else whole


def cross_colour(ch: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    h, w, _ = ch.shape
    at = elements[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    signed = lambda x: ((x & 255) ^ 128) - 128
    g2r, g2b, r2b = signed(at[..., 3]), signed(at[..., 2]), signed(at[..., 1])
    green, red, blue = signed(ch[..., 2]), ch[..., 1], ch[..., 3]
    way = -1 if forward else 1
    new_red = red + way * (g2r * green >> 5)
    known_red = red if forward else new_red
    new_blue = blue + way * ((g2b * green >> 5) + (r2b * signed(known_red) >> 5))
    return np.stack([ch[..., 0], new_red & 255, ch[..., 2], new_blue & 255], axis=-1)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def invert(pixels: np.ndarray, transforms: list, width: int, height: int) -> np.ndarray:
    for kind, own_width, info in reversed(transforms):
        if kind == PALETTE:
            table = info
            bits = palette_bits(len(table))
            packed = (pixels.reshape(height, -1) >> 8 & 255).astype(np.int64)
            x, each = np.arange(own_width), 8 >> bits
            index = packed[:, x >> bits] >> (each * (x & (1 << bits) - 1)) & (1 << each) - 1
            pixels = np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).astype(np.uint32).ravel()
            continue
        ch = channels(pixels.reshape(height, own_width))
        if kind == SUBTRACT_GREEN:
            ch[..., 1] += ch[..., 2]
            ch[..., 3] += ch[..., 2]
        elif kind == PREDICTOR:
            ch = prediction_walk(ch, (info[1] >> 8 & 15).astype(np.int64), info[0], False)
        else:
            ch = cross_colour(ch, channels(info[1]), info[0], False)
        pixels = pixels_of(ch).ravel()
    return pixels


def open_stream(stream: bytes) -> tuple[Job, list, int, int]:
    """Header and transforms of a lossless bitstream."""
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("a version that isn't known")
    transforms, own = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, _, _ in transforms):
            raise ValueError("a transform that comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, own, (size, sub_image(bits, -(-own >> size), -(-height >> size)))))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = pixels_of(np.cumsum(channels(sub_image(bits, n, 1)[0]), axis=0))
            transforms.append((kind, own, table))
            own = -(-own >> palette_bits(n))
        else:
            transforms.append((kind, own, None))
    return Job(bits, own, height, True), transforms, width, height


def chunks(data: bytes):
    at = 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def streams_of(file: bytes) -> list[bytes]:
    """The lossless bitstreams of a file: one, or one a frame."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    found = []
    for name, body in chunks(file[12 : 8 + int.from_bytes(file[4:8], "little")]):
        if name == b"VP8L":
            found.append(body)
        elif name == b"ANMF":
            found += [b for n, b in chunks(body[16:]) if n == b"VP8L"]
    return found


def decode_files(files: list[bytes]) -> list[list[np.ndarray]]:
    """Of each file its frames, each (height, width) uint32 ARGB."""
    opened = [[open_stream(s) for s in streams_of(f)] for f in files]
    flat = [x for o in opened for x in o]
    pixels, _ = decode_pixels([x[0] for x in flat]) if flat else ([], [])
    made = iter([invert(p, t, w, h).reshape(h, w) for p, (_, t, w, h) in zip(pixels, flat)])
    return [[next(made) for _ in o] for o in opened]


# ---- encoding


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0].tolist()
    if len(used) <= 2 and all(u < 256 for u in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for u in used:
            out.put(u, 8)
        return
    runs: list[tuple[int, int, int]] = []
    known = lengths[: used[-1] + 1]
    each, at = known.tolist(), 0
    for end in [*((known[1:] != known[:-1]).nonzero()[0] + 1).tolist(), len(each)]:
        length, n, at = each[at], end - at, end
        if n == 1:
            runs.append((length, 0, 0))
            continue
        if length == 0:
            while n >= 3:
                take = min(n, 138)
                runs.append((18, take - 11, 7) if take > 10 else (17, take - 3, 3))
                n -= take
        elif n > 3:
            runs.append((length, 0, 0))
            n -= 1
            while n >= 3:
                take = min(n, 6)
                runs.append((16, take - 3, 2))
                n -= take
        runs += [(length, 0, 0)] * n
    counts = np.bincount([r[0] for r in runs], minlength=19)
    small = code_lengths(counts, 7)
    codes = codes_of(small)
    out.put(0, 1)
    own_bits = small.tolist()
    kept = max(4, max(i for i, k in enumerate(LENGTH_ORDER) if own_bits[k]) + 1)
    out.put(kept - 4, 4)
    out.put(sum(own_bits[k] << 3 * i for i, k in enumerate(LENGTH_ORDER[:kept])), 3 * kept)
    out.put(1, 1)
    bits = max(2, (len(runs) - 2).bit_length() + 1 & ~1)
    out.put((bits - 2) // 2, 3)
    out.put(len(runs) - 2, bits)
    if own_bits.count(0) == len(own_bits) - 1:
        own_bits = [0] * len(own_bits)
    own_codes = codes.tolist()
    value = at = 0
    for symbol, extra, n in runs:
        value |= (own_codes[symbol] | extra << own_bits[symbol]) << at
        at += own_bits[symbol] + n
    out.put(value, at)


def value_prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + (v >> extra & 1) + 2, v & (1 << extra) - 1, extra


def copies_of(px: np.ndarray, width: int, least: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, distance code) of runs of pixels that repeat earlier ones: the pixel before, the row above, or where the same four last were."""
    found = []
    for dist, code in ((1, 2), (width, 1)):
        if len(px) <= dist:
            continue
        same = np.concatenate(([False], px[dist:] == px[:-dist], [False]))
        edges = (same[1:] != same[:-1]).nonzero()[0].tolist()
        found += [(a + dist, b - a, code) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]
    if len(px) > least:
        key = np.zeros(len(px) - least + 1, np.uint64)
        for k in range(least):
            key = (key ^ px[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        # sorted with the place in the low bits: equal keys by place; that few keys meet in the others is seen below
        low = np.uint64((1 << len(key).bit_length()) - 1)
        key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        key.sort()
        order, far = (key & low).view(np.int64), np.zeros(len(key), np.int64)
        meet = (key[1:] ^ key[:-1]) <= low
        now, last = order[1:][meet], order[:-1][meet]
        for k in range(least):
            same = px[now + k] == px[last + k]
            now, last = now[same], last[same]
        far[now] = now - last
        if len(now):
            cuts = np.concatenate(([0], (far[1:] != far[:-1]).nonzero()[0] + 1, [len(far)]))
            own = far[cuts[:-1]]
            kept = ((own > 1) & (own != width)).nonzero()[0]
            found += zip(cuts[kept].tolist(), (cuts[kept + 1] - cuts[kept] + (least - 1)).tolist(), (own[kept] + 120).tolist())
    out, at = [], 0
    for start, n, code in sorted(found, key=lambda f: (f[0], -f[1])):
        if start < at:
            n, start = n - (at - start), at
        while n >= least:
            take = min(n, 4096)
            out.append((start, take, code))
            start, n = start + take, n - take
        at = max(at, out[-1][0] + out[-1][1]) if out else at
    return out


def write_pixels(out: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, copies: bool = True) -> None:
    """Codes and data of an image; groups: (bits, map of group numbers), with codes for each group."""
    n = len(px)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    where = None
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            bits, numbers = groups
            out.put(bits - 2, 3)
            write_pixels(out, (numbers.astype(np.uint32) << 8 | 0xFF000000).ravel().astype(np.uint32), numbers.shape[1], False)
            i = np.arange(n)
            where = numbers[i // width >> bits, i % width >> bits]
    covered, heads = np.zeros(n, bool), copies_of(px, width) if copies else []
    for start, length, _ in heads:
        covered[start : start + length] = True
    symbol = (px >> 8 & 255).astype(np.int64)
    literal = ~covered
    if cache_bits:
        slot = ((px.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
        if n and px[0] == 0:
            hit[0] = False
        hit &= literal
        symbol[hit] = 280 + slot[hit]
        literal &= ~hit
    red, blue, alpha = ((px >> s & 255).astype(np.int64) for s in (16, 0, 24))
    marks = [(start, value_prefix(length), value_prefix(code)) for start, length, code in heads]
    starts = np.ones(n, bool)
    starts[covered] = False
    for start, (s, _, _), _ in marks:
        starts[start] = True
        symbol[start] = 256 + s
    alphabet = 280 + (1 << cache_bits if cache_bits else 0)
    value, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    lengths_of_copies = {}
    for g in range(1 if where is None else int(where.max()) + 1):
        own, lit = ((x if where is None else x & (where == g)).nonzero()[0] for x in (starts, literal))
        rest_of = [ch[lit] for ch in (red, blue, alpha)]
        green = code_lengths(np.bincount(symbol[own], minlength=alphabet), LONGEST_CODE)
        rest = code_lengths(np.bincount(np.concatenate(rest_of), minlength=256), LONGEST_CODE)
        far = code_lengths(np.bincount([d[0] for s, _, d in marks if where is None or where[s] == g], minlength=40))
        write_code(out, green)
        shared = Writer()
        write_code(shared, rest)
        for _ in range(3):  # red, blue, alpha
            out.put(shared.value, shared.at)
        write_code(out, far)
        sizes = [x * (np.count_nonzero(x) > 1) for x in (green, rest, far)]
        codes = [codes_of(x) for x in (green, rest, far)]
        value[own], size[own] = codes[0].view(np.uint64)[symbol[own]], sizes[0][symbol[own]]
        made, bits = value[lit], size[lit]
        for ch in rest_of:
            made |= codes[1].view(np.uint64)[ch] << bits.view(np.uint64)
            bits += sizes[1][ch]
        value[lit], size[lit] = made, bits
        lengths_of_copies[g] = (codes[2].tolist(), sizes[2].tolist())
    if marks:
        tails = []
        for start, (_, extra, bits), (d, more, more_bits) in marks:
            codes, sizes = lengths_of_copies[0 if where is None else int(where[start])]
            tails.append((start, extra | (codes[d] | more << sizes[d]) << bits, bits + sizes[d] + more_bits))
        at, tail, bits = (np.array(x, np.int64) for x in zip(*tails))
        value[at] |= tail.view(np.uint64) << size[at].view(np.uint64)
        size[at] += bits
    value, size = value[starts], size[starts]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = ends - size + (out.at & 7)
    words = np.zeros((total + (out.at & 7) >> 6) + 2, np.uint64)
    if len(value):
        slot, shift = at >> 6, (at & 63).astype(np.uint64)
        firsts = np.concatenate(([0], (slot[1:] != slot[:-1]).nonzero()[0] + 1))
        words[slot[firsts]] = np.bitwise_or.reduceat(value << shift, firsts)
        over = ((at & 63) + size > 64).nonzero()[0]
        words[slot[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    out.put(int.from_bytes(words.tobytes(), "little") >> (out.at & 7), total)


def encode_stream(argb: np.ndarray, transforms: list | tuple = (), cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, copies: bool = True) -> bytes:
    """A lossless bitstream of (height, width) uint32 pixels.

    transforms, applied in order: (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, elements), (SUBTRACT_GREEN,), (PALETTE,).
    """
    height, width = argb.shape
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    px, own = argb, width
    for kind, *info in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PALETTE:
            table, index = np.unique(px, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette of over 256 colours")
            out.put(len(table) - 1, 8)
            ch = channels(table)
            write_pixels(out, pixels_of(np.diff(ch, axis=0, prepend=0)), len(table), False)
            bits = palette_bits(len(table))
            own, each = -(-own >> bits), 8 >> bits
            index = index.reshape(px.shape)
            index = np.pad(index, ((0, 0), (0, (own << bits) - index.shape[1])))
            packed = sum(index[:, i :: 1 << bits] << (each * i) for i in range(1 << bits))
            px = (packed.astype(np.uint32) << 8 | 0xFF000000).astype(np.uint32)
            continue
        ch = channels(px)
        if kind == SUBTRACT_GREEN:
            ch[..., 1] -= ch[..., 2]
            ch[..., 3] -= ch[..., 2]
        else:
            bits, given = info
            out.put(bits - 2, 3)
            stored = (given.astype(np.uint32) << 8 | 0xFF000000).astype(np.uint32) if kind == PREDICTOR else given.astype(np.uint32)
            write_pixels(out, stored.ravel(), stored.shape[1], False)
            ch = prediction_walk(ch, given, bits, True) if kind == PREDICTOR else cross_colour(ch, channels(stored), bits, True)
        px = pixels_of(ch)
    out.put(0, 1)
    write_pixels(out, px.ravel(), own, True, cache_bits, groups, copies)
    return out.value.to_bytes((out.at + 7) // 8, "little")


def chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def riff(body: bytes) -> bytes:
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def certainty(samples: np.ndarray) -> int:
    """How alike the values of each of the four channels are: the larger, the fewer bits they take. Sums of n * log2(n) over the counts, in whole 2^-20."""
    n = np.bincount((samples.reshape(-1, 4) + CHANNEL).ravel(), minlength=1024)
    n = n[n > 1]
    return int((n * np.log2(n) * (1 << 20)).astype(np.int64).sum())


def predicted(px: np.ndarray, bits: int = 4) -> list | None:
    """Prediction from the left or the row above, by block, then cross-colour; nothing if the residues are no easier to store."""
    # every fourth row tells whether it is worth a try; bytes wrap as the format's residues do
    some = np.ascontiguousarray(px).view(np.uint8).reshape(*px.shape, 4)
    above = some[3:-1:4]
    some = some[::4]
    left, top = some.copy(), some.copy()
    left[:, 1:] -= some[:, :-1]
    top[1:] -= above[: len(some) - 1]  # nothing is above the first row
    if max(certainty(left), certainty(top)) <= certainty(some):
        return None
    ch = channels(px)
    steps = [np.diff(ch, axis=k, prepend=0) for k in (1, 0)]
    left, top = (np.minimum(r & 255, 256 - (r & 255)).sum(axis=-1) for r in steps)
    h, w = px.shape
    rows, cols = np.arange(0, h, 1 << bits), np.arange(0, w, 1 << bits)
    blocks = [np.add.reduceat(np.add.reduceat(x, rows, axis=0), cols, axis=1) for x in (left, top)]
    modes = np.where(blocks[0] <= blocks[1], 1, 2)
    rest = prediction_walk(ch, modes, bits, True)
    signed = lambda x: (x ^ 128) - 128.0
    green = signed(rest[..., 2]).ravel()
    slope = [int(np.clip(round(32 * float(green @ signed(rest[..., k]).ravel()) / max(1.0, float(green @ green))), -128, 127)) & 255 for k in (1, 3)]
    elements = np.full((1 + (h - 1 >> 9), 1 + (w - 1 >> 9)), 0xFF000000 | slope[1] << 8 | slope[0], np.uint32)
    return [(PREDICTOR, bits, modes), (CROSS_COLOUR, 9, elements)]


def worth(px: np.ndarray, distinct: int, cache_bits: int) -> int:
    """The bits of a cache that an eighth of the pixels would be found in, else 0."""
    flat = px.ravel()
    if 8 * (flat.size - distinct) < flat.size:
        return 0
    slot = (flat.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    return cache_bits if 8 * np.count_nonzero(flat[order[1:]] == flat[order[:-1]]) >= flat.size else 0


def shortest(px: np.ndarray, cache_bits: int = CACHE_BITS) -> tuple[bytes, str]:
    """The shortest of a frame's encodings, and the name of its transforms."""
    flat = np.sort(px, axis=None)
    distinct = 1 + np.count_nonzero(flat[1:] != flat[:-1])
    made = [(encode_stream(px, (), worth(px, distinct, cache_bits)), "plain")]
    if 4 * distinct <= min(1024, px.size):
        made.append((encode_stream(px, [(PALETTE,)]), "palette"))
    transforms = predicted(px)
    if transforms:
        made.append((encode_stream(px, transforms), "predicted"))
    return min(made, key=lambda m: len(m[0]))


def store(payload: bytes, row_bytes: int = ROW_BYTES, frame_rows: int = FRAME_ROWS) -> tuple[bytes, list[str]]:
    """A payload of whole rows as a WebP file, and what transforms each frame has."""
    width, three = row_bytes // 4, lambda v: v.to_bytes(3, "little")
    frames, names = [], []
    for at in range(0, len(payload), row_bytes * frame_rows):
        px = np.frombuffer(payload[at : at + row_bytes * frame_rows], ">u4").astype(np.uint32).reshape(-1, width)
        stream, name = shortest(px)
        frames.append((at // row_bytes, px.shape[0], stream))
        names.append(name)
    head = chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + three(width - 1) + three(len(payload) // row_bytes - 1)) + chunk(b"ANIM", bytes(6))
    return riff(head + b"".join(chunk(b"ANMF", three(0) + three(y // 2) + three(width - 1) + three(h - 1) + three(0) + b"\2" + chunk(b"VP8L", s)) for y, h, s in frames)), names


def payload_of(frames: list[np.ndarray]) -> bytes:
    return b"".join(f.astype(">u4").tobytes() for f in frames)


def feature(pixels: bytes) -> str:
    """Rows, mean sample, share of samples by quarter of their range, and mean step between pixels above each other."""
    samples = np.frombuffer(pixels, np.uint8)
    counts = np.bincount(samples, minlength=256)
    quarters = counts.reshape(4, 64).sum(axis=1)
    rows = samples.reshape(-1, ROW_BYTES).astype(np.int16)
    step = int(np.abs(rows[1:] - rows[:-1]).sum(dtype=np.int64)) // max(1, rows[1:].size)
    return f"rows={len(rows)};mean={int(counts @ np.arange(256)) * 1000 // len(samples)};quarters={'/'.join(map(str, quarters.tolist()))};step={step}"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, transforms (which frames have)."""

    def make():
        def through(batch: pa.RecordBatch):
            ids = batch["doc_id"].to_pylist()
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            out = Columns((n, []) for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "transforms"))
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_BYTES):
                    held += len(texts[end])
                    end += 1
                part = texts[at:end]
                stored = [store(t + b"\xff" * (-len(t) % ROW_BYTES if t else ROW_BYTES)) for t in part]
                for doc_id, text, (file, names), frames in zip(ids[at:end], part, stored, decode_files([f for f, _ in stored])):
                    data = payload_of(frames)
                    for name, value in zip(out, (doc_id, len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(data), ",".join(sorted(set(names))))):
                        out[name].append(value)
                at = end
            return out

        return through

    return map_slices(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, transforms string", 2048)
