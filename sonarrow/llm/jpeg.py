"""Baseline JPEG in numpy: a reader for DC thumbnails and a writer that stores bytes as the DC samples of blocks.

Reader: markers are parsed (SOI, APPn, COM, DQT, DHT, SOF0/SOF1, DRI, SOS, RSTn, EOI), the scan is cut at its restart
markers, and all intervals of all images of a batch are Huffman-decoded in lockstep: each numpy step reads one symbol of
every interval that has not ended. Of the coefficients only the DC ones are kept; a DC value divided by 8 plus the level
shift is the mean of its 8x8 block, so the DC values of the first component are the luminance at an eighth of its size.

Writer: a block that is one grey value has no AC coefficients, and with a DC quantizer of 8 its DC coefficient is exactly
that value minus 128. A payload byte is therefore stored as one block, losslessly; 64 blocks make a row, a row is a
restart interval, and an image has at most `ROWS` rows; longer payloads become several images, one after another.
"""

from __future__ import annotations

import numpy as np

#: Blocks across, and the most rows of blocks in an image (JPEG dimensions are below 2**16).
ACROSS, ROWS = 64, 8191

# Fixed values of the format: the order in which quantizers are stored, and the code lengths and symbols of the writer's
# DC table (9 sizes of differences) and AC table (the end of a block alone).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [5, 0, 4, 3, 6, 2, 7, 8, 1]
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def canonical(counts, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table in its stored form."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits that may come next: the code's length times 256 plus its symbol, or 0 where there is no code."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in canonical(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


_DC = np.zeros((9, 2), np.uint64)
for _s, _c, _n in canonical(DC_COUNTS, DC_SYMBOLS):
    _DC[_s] = _c, _n


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    quant = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]), bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + b"".join(_segment(0xC4, t) for t in tables) + _segment(0xDD, ACROSS.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _intervals(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of 64 blocks, padded with ones and stuffed."""
    rows = len(payload) // ACROSS
    v = payload.reshape(rows, ACROSS).astype(np.int64) - 128
    d = np.diff(v, axis=1, prepend=0).ravel()
    a = np.abs(d)
    size = np.zeros(256, np.int64)
    for k in range(8):
        size[1 << k :] = k + 1
    size = size[a]
    extra = np.where(d < 0, d + (1 << size) - 1, d).astype(np.uint64)
    sz = size.astype(np.uint64)
    # code, extra bits, then the one-bit end of block, a zero
    bits = ((_DC[size, 0] << sz | extra) << np.uint64(1)).reshape(rows, ACROSS)
    lens = (_DC[size, 1].astype(np.int64) + size + 1).reshape(rows, ACROSS)
    total = lens.sum(axis=1)
    n_bytes = (total + 7) // 8
    words = (n_bytes + 3) // 4 + 1
    base = np.concatenate([[0], np.cumsum(words)])
    at = np.cumsum(lens, axis=1) - lens + base[:-1, None] * 32
    pad = n_bytes * 8 - total
    bits = np.concatenate([bits, ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))[:, None]], axis=1).ravel()
    at = np.concatenate([at, (base[:-1] * 32 + total)[:, None]], axis=1).ravel()
    lens = np.concatenate([lens, pad[:, None]], axis=1).ravel()
    word, shift = at >> 5, (64 - (at & 31) - lens).astype(np.uint64)
    bits = bits << shift
    out = np.zeros(int(base[-1]) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # bits are disjoint, so their sum is their union
    out[word[first]] = np.add.reduceat(bits >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    raw = out.astype(">u4").tobytes()
    return [raw[4 * b : 4 * b + n].replace(b"\xff", b"\xff\x00") for b, n in zip(base[:-1].tolist(), n_bytes.tolist(), strict=True)]


def encode(payload: np.ndarray, lengths: list[int]) -> list[bytes]:
    """One stored form for each of the payloads that lie one after another in `payload`; lengths are multiples of 64."""
    step = (ROWS + 1) * ACROSS  # rows are coded apart, so this bounds what is held beside the result
    rows = [x for at in range(0, len(payload), step) for x in _intervals(payload[at : at + step])]
    out, k = [], 0
    for n in lengths:
        part = []
        for at in range(0, n // ACROSS, ROWS):
            own = rows[k + at : k + min(at + ROWS, n // ACROSS)]
            part.append(_head(len(own)))
            for i, x in enumerate(own):
                part.append(x)
                if i + 1 < len(own):
                    part.append(bytes([0xFF, 0xD0 + i % 8]))
            part.append(b"\xff\xd9")
        out.append(b"".join(part))
        k += n // ACROSS
    return out


class Image:
    """What the markers of one image say; `scan` holds the cut intervals of its entropy-coded bytes, still stuffed."""

    def __init__(self):
        self.width = self.height = self.restart = 0
        self.components: list[dict] = []
        self.quant: dict[int, int] = {}
        self.huffman: dict[tuple[int, int], tuple[tuple, tuple]] = {}
        self.scan: list[bytes] = []

    @property
    def bytes(self) -> int:
        return sum(map(len, self.scan))

    def units(self) -> tuple[int, int, list[int]]:
        """How many coding units lie across and down, and which component each block of one belongs to."""
        c = self.components
        if len(c) == 1:
            return -(-self.width // 8), -(-self.height // 8), [0]
        h, v = max(x["h"] for x in c), max(x["v"] for x in c)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), [i for i, x in enumerate(c) for _ in range(x["h"] * x["v"])]

    def check(self) -> None:
        """Raises ValueError unless the scan can be decoded as far as the markers tell."""
        if not self.width or not self.height or not self.scan:
            raise ValueError("an image without frame, size or scan")
        if not 1 <= len(self.components) <= 4 or any(not 1 <= x <= 4 for c in self.components for x in (c["h"], c["v"])):
            raise ValueError("bad sampling factors")
        for c in self.components:
            if c["q"] not in self.quant or (0, c["dc"]) not in self.huffman or (1, c["ac"]) not in self.huffman:
                raise ValueError("a table is missing")
        across, down, order = self.units()
        if 2 * across * down * len(order) > 8 * self.bytes:  # a block takes two bits at least
            raise ValueError("the scan is too short for the image")
        if len(self.scan) != -(-across * down // (self.restart or across * down)):
            raise ValueError("intervals are missing")


def parse(data: bytes) -> list[Image]:
    """The images of `data`, one after another. Raises ValueError for what is not baseline JPEG with one interleaved scan."""
    try:
        images = _parsed(data)
    except IndexError:
        raise ValueError("a segment is too short") from None
    if not images:
        raise ValueError("no image")
    for im in images:
        im.check()
    return images


def _parsed(data: bytes) -> list[Image]:
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        im, at = Image(), at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("no marker")
            m = data[at + 1]
            at += 2
            if m == 0xD9:
                break
            n = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + n]
            if n < 2 or len(body) != n - 2:
                raise ValueError("a segment is cut off")
            at += n
            if m == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC one comes first
                    body = body[1 + 64 * (1 + wide) :]
            elif m == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    k = 17 + sum(counts)
                    if len(body) < k or sum(n << (16 - i) for i, n in enumerate(counts, 1)) > 1 << 16:
                        raise ValueError("a Huffman table is too short or has too many codes")
                    im.huffman[body[0] >> 4, body[0] & 15] = counts, tuple(body[17:k])
                    body = body[k:]
            elif m in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                im.components = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            elif 0xC2 <= m <= 0xCF and m != 0xCC:
                raise ValueError("not baseline")
            elif m == 0xDD:
                im.restart = int.from_bytes(body[:2], "big")
            elif m == 0xDA:
                if not im.components or body[0] != len(im.components):
                    raise ValueError("the scan does not hold all components")
                for i, c in enumerate(im.components):
                    c["dc"], c["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                end = at
                cuts = [at]
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise ValueError("the scan does not end")
                    if 0xD0 <= data[end + 1] <= 0xD7:
                        im.scan.append(data[cuts[-1] : end])
                        cuts.append(end + 2)
                    elif data[end + 1] not in (0, 0xFF):
                        break
                    end += 1 + (data[end + 1] != 0xFF)
                im.scan.append(data[cuts[-1] : end])
                at = end
        images.append(im)
    return images


def dc_planes(images: list[Image]) -> list[np.ndarray]:
    """For each image the thumbnail of its first component: one 8-bit sample for each 8x8 block.

    Raises ValueError if a scan is not what its tables and its image's size call for.
    """
    try:
        return _dc_planes(images)
    except IndexError:
        raise ValueError("a scan is too short") from None


def _dc_planes(images: list[Image]) -> list[np.ndarray]:
    tables: dict = {}
    lookups: list[np.ndarray] = []

    def table(im, kind, k):
        key = im.huffman[kind, k]
        if key not in tables:
            tables[key] = len(lookups)
            lookups.append(_lookup(*key))
        return tables[key]

    parts, plan, n_blocks = [], [], []
    layouts: dict = {}
    layout_dc, layout_ac, layout_comp = [], [], []
    for im in images:
        across, down, order = im.units()
        units = across * down
        each = im.restart or units
        key = tuple((i, table(im, 0, im.components[i]["dc"]), table(im, 1, im.components[i]["ac"])) for i in order)
        if key not in layouts:
            layouts[key] = len(layout_dc)
            layout_dc.append([x[1] for x in key])
            layout_ac.append([x[2] for x in key])
            layout_comp.append([x[0] for x in key])
        plan.append((len(parts), across, down, order, each, units))
        for i, x in enumerate(im.scan):
            parts.append(x.replace(b"\xff\x00", b"\xff"))
            n_blocks.append((layouts[key], min(each, units - i * each) * len(order)))
    longest = max(map(len, layout_dc))
    grow = lambda rows: np.array([r + [0] * (longest - len(r)) for r in rows])
    ldc, lac, lcomp, per = grow(layout_dc), grow(layout_ac), grow(layout_comp), np.array([len(r) for r in layout_dc])
    lut = np.concatenate(lookups).astype(np.int64)

    lens = np.array([len(x) for x in parts])
    base = np.concatenate([[0], np.cumsum(lens + 8)])
    raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in parts) + b"\xff" * 8, np.uint8)
    words = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        words |= raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)

    layout, total = np.array(n_blocks, np.int64).T
    start = np.concatenate([[0], np.cumsum(total)])
    values = np.zeros(int(start[-1]), np.int64)
    live = np.arange(len(parts))
    bit, last_bit = base[:-1] * 8, (base[:-1] + lens) * 8
    block, k = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    pred = np.zeros((len(parts), 4), np.int64)
    n_u = np.uint64
    alike = len(per) == 1 and per[0] == 1  # all blocks use the same two tables
    while len(live):
        dc = k == 0
        every, some = dc.all(), dc.any()
        if alike and every:
            which = ldc[0, 0] << 16
        elif alike and not some:
            which = lac[0, 0] << 16
        else:
            lay = layout[live]
            unit = block % per[lay]
            which = np.where(dc, ldc[lay, unit], lac[lay, unit]) << 16
        window = words[bit >> 3] << (bit & 7).astype(n_u)
        code = lut[which + (window >> n_u(48)).astype(np.int64)]
        length, symbol = code >> 8, code & 255
        size = symbol & 15
        if not length.all():
            raise ValueError("a code that the table does not hold")
        bit = bit + (length + size)
        if some:
            who = slice(None) if every else np.flatnonzero(dc)
            sz = size[who]
            extra = (window[who] << length[who].astype(n_u) >> n_u(1) >> (63 - sz).astype(n_u)).astype(np.int64)
            diff = np.where(extra < (1 << sz) >> 1, extra - (1 << sz) + 1, extra)
            if alike:
                pred[who, 0] += diff
                values[start[live[who]] + block[who]] = pred[who, 0]
            else:
                who = np.flatnonzero(dc)
                comp = lcomp[lay[who], unit[who]]
                pred[who, comp] += diff
                values[start[live[who]] + block[who]] = pred[who, comp]
        if every:
            k = k + 1
        else:
            k = np.where(dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
            done = k >= 64
            block = block + done
            k[done] = 0
            if (bit > last_bit).any():
                raise ValueError("an interval is too short")
            on = block < total[live]
            if not on.all():
                live, bit, last_bit, block, k, pred = live[on], bit[on], last_bit[on], block[on], k[on], pred[on]

    out = []
    for im, (p, across, down, order, each, units) in zip(images, plan, strict=True):
        n = -(-units // each)
        v = values[start[p] : start[p + n]].reshape(units, len(order))[:, [i for i, c in enumerate(order) if c == 0]]
        c = im.components[0]
        h, w = (c["v"], c["h"]) if len(im.components) > 1 else (1, 1)
        plane = v.reshape(down, across, h, w).transpose(0, 2, 1, 3).reshape(down * h, across * w)
        hs, vs = max(x["h"] for x in im.components), max(x["v"] for x in im.components)
        wide = -(-(-(-im.width * c["h"] // hs)) // 8) if len(im.components) > 1 else across
        high = -(-(-(-im.height * c["v"] // vs)) // 8) if len(im.components) > 1 else down
        plane = plane[:high, :wide] * im.quant[c["q"]]
        out.append(np.clip((plane + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def feature(images: list[Image], planes: list[np.ndarray]) -> str:
    """The dimensions of each image and a difference hash of all thumbnails: is a cell of a 9x8 grid brighter than the next?"""
    dims = ",".join(f"{im.width}x{im.height}" for im in images)
    x = planes[0] if len(planes) == 1 else np.concatenate([p[:, : min(q.shape[1] for q in planes)] for p in planes])
    grow = (max(1, -(-8 // x.shape[0])), max(1, -(-9 // x.shape[1])))
    x = np.repeat(np.repeat(x, grow[0], 0), grow[1], 1).astype(np.int64)
    rows, cols = np.arange(8) * x.shape[0] // 8, np.arange(9) * x.shape[1] // 9
    total = np.add.reduceat(np.add.reduceat(x, rows, 0), cols, 1)
    count = np.diff(np.append(rows, x.shape[0]))[:, None] * np.diff(np.append(cols, x.shape[1]))[None]
    mean = total * 1000 // count
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return f"{dims};dhash={int(np.packbits(bits).tobytes().hex(), 16):016x}"
