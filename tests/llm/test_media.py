"""JPEG storing and reading: exact round trips, and a general image against a plain decoder."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sonarrow.llm import jpeg, media

DOCS = [(1, "hello"), (2, None), (3, ""), (4, "é" * 64), (5, "x" * 600_000), (1, "hello"), (None, "\x00\xff end"), (7, "".join(chr(random.Random(1).randrange(32, 2000)) for _ in range(5000)))]


def test_digests(spark):
    d = spark.createDataFrame([(i, t, "w", 9) for i, t in DOCS], "doc_id long, text string, width string, n_bytes2 int")
    got = media.digests(d).collect()
    assert len(got) == len(DOCS)
    by = {}
    for r in got:
        raw = (r.text or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert by.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    stored = media.store(d.select("doc_id", "text")).withColumnRenamed("media", "m")
    thumbs = media.thumbnails(stored, media_col="m").collect()
    assert all(r.error is None and r.width == 512 for r in thumbs)
    for r in thumbs:
        raw = (r.text or "").encode()
        assert bytes(r.thumbnail)[: len(raw)] == raw[: len(r.thumbnail)]
    assert media.digests(d.where("doc_id = 99")).count() == 0


def test_damaged(spark):
    d = spark.createDataFrame([(1, bytearray(b"no image")), (2, None), (3, bytearray(b"\xff\xd8\xff\xda"))], "id int, media binary")
    got = {r.id: r for r in media.thumbnails(d).collect()}
    assert got[1].error and got[3].error and got[2].error is None and got[2].width is None


def _general(width, height, comps, restart, rng):
    """An image with AC coefficients and subsampled colour, written one bit at a time, and its DC values."""
    dc = jpeg.canonical(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)
    ac_counts, ac_symbols = [0, 1, 2, 1] + [0] * 12, [0, 0x11, 0x02, 0xF0]
    ac = jpeg.canonical(ac_counts, ac_symbols)
    code = lambda t, s: next(format(c, f"0{n}b") for x, c, n in t if x == s)
    hs, vs = max(c[0] for c in comps), max(c[1] for c in comps)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    parts, bits, pred, first = [], "", [0] * len(comps), []
    for u in range(across * down):
        if restart and u and u % restart == 0:
            parts.append(bits)
            bits, pred = "", [0] * len(comps)
        for i, (h, v) in enumerate(comps):
            for _ in range(h * v):
                new = rng.randrange(-100, 100)
                d = new - pred[i]
                pred[i] = new
                n = abs(d).bit_length()
                bits += code(dc, n) + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
                for s in rng.choice([[], [0x11], [0x02, 0x11], [0xF0, 0x02]]):
                    bits += code(ac, s) + (format(rng.randrange(1 << (s & 15)), f"0{s & 15}b") if s & 15 else "")
                bits += code(ac, 0)
                if i == 0:
                    first.append((u, new))
    parts.append(bits)
    raw = []
    for k, b in enumerate(parts):
        b += "1" * (-len(b) % 8)
        raw.append(int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b""))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(comps))
    seg = jpeg._segment
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xFE, b"note") + seg(0xDB, bytes([0] + [4] * 64)) + seg(0xC0, frame)
    out += seg(0xC4, bytes([0x00, *jpeg.DC_COUNTS, *jpeg.DC_SYMBOLS]) + bytes([0x10, *ac_counts, *ac_symbols]))
    out += (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in range(len(comps))) + bytes([0, 63, 0]))
    h, v = comps[0]
    plane = np.zeros((down * v, across * h), int)
    for k, (u, x) in enumerate(first):
        j = k % (h * v)
        plane[u // across * v + j // h, u % across * h + j % h] = x
    return out + b"".join(raw) + b"\xff\xd9", plane


@pytest.mark.parametrize("comps", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
def test_general(comps, restart):
    rng = random.Random(5)
    data, plane = _general(83, 45, comps, restart, rng)
    images = jpeg.parse(data)
    (got,) = jpeg.dc_planes(images)
    assert (images[0].width, images[0].height) == (83, 45) and got.shape == (6, 11)
    want = np.clip((plane[:6, :11] * 4 + 4) // 8 + 128, 0, 255)
    assert (got == want).all()
    with pytest.raises(ValueError):
        jpeg.parse(data[:-2])


def test_clashing_columns_and_long_texts(spark):
    """Computed columns replace those of their names; a long text is stored as many images and read back whole."""
    text = "".join(random.Random(2).choices("abcdefgh é", k=2_500_000))
    d = spark.createDataFrame([(1, text, 7, 7), (2, None, 7, 7)], "doc_id long, text string, FEATURE string, _text int")
    got = media.digests(d)
    assert got.columns == ["doc_id", "text", "_text", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    r = got.where("doc_id = 1").first()
    raw = text.encode()
    assert r.payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest() and r.n_bytes == len(raw)
    (stored,) = jpeg.encode(np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8), [len(raw) + (-len(raw) % 64)])
    assert len(jpeg.parse(stored)) == -(-len(raw) // (64 * jpeg.ROWS)) and hashlib.sha256(stored).hexdigest() == r.media_sha256
    clash = spark.createDataFrame([(b"none", 1, 1)], "media binary, Error int, width int")
    assert media.thumbnails(clash).columns == ["media", "width", "height", "thumbnail", "feature", "error"]


def test_any_bytes_are_read_or_refused():
    """Damaged images give samples or a ValueError, never another error, and nothing their bytes cannot hold."""
    rng = np.random.default_rng(9)
    (good,) = jpeg.encode(rng.integers(0, 256, 640).astype(np.uint8), [640])
    frame = good.index(b"\xff\xc0")
    sizes = {"height": frame + 5, "width": frame + 7, "factors": frame + 11}
    odd = [b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", good[: frame + 4], good * 2]
    for place, value in ((sizes["height"], b"\0\0"), (sizes["height"], b"\xff\xff"), (sizes["width"], b"\xff\xff"), (sizes["factors"], b"\0"), (sizes["factors"], b"\xff")):
        odd.append(good[:place] + value + good[place + len(value) :])
    for _ in range(400):
        x = bytearray(good)
        for _ in range(int(rng.integers(1, 4))):
            x[int(rng.integers(0, len(x)))] = int(rng.integers(0, 256))
        odd.append(bytes(x[: int(rng.integers(2, len(x) + 1))] if rng.random() < 0.3 else x))
    refused = 0
    for x in odd:
        try:
            images = jpeg.parse(x)
            assert sum(p.size for p in jpeg.dc_planes(images)) <= 4 * len(x)
        except ValueError:
            refused += 1
    assert 50 < refused < len(odd)
