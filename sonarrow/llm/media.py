"""Media columns: payloads stored as baseline JPEG, and dimensions and thumbnail hashes of stored JPEGs."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .arrow import append
from .words import slices

#: Bytes of payload that are coded together.
BLOCK = 1 << 20


def store(docs: DataFrame, *, text_col="text", out="media") -> DataFrame:
    """`docs` with each whole text (null: empty) as UTF-8, zero-padded to a positive multiple of 64, stored as JPEG.

    Equal texts give equal bytes, and an empty table an empty one. `out` replaces a column of `docs` with its name; other
    names do not matter. A long text is coded image by image, so that a task holds a few times its bytes.
    """

    def make():
        def f(texts):
            got = []
            for s in slices(texts, BLOCK):
                got += jpeg.encode(*_payload(s))
            return [pa.array(got, pa.binary())]

        return f

    return append(docs, text_col, make, f"`{out}` binary")


def _payload(s) -> tuple[np.ndarray, list[int]]:
    n = np.diff(s.at)
    padded = np.maximum(-(-n // jpeg.ACROSS), 1) * jpeg.ACROSS
    to = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(to[-1]), np.uint8)
    where = np.arange(len(s.data)) + np.repeat(to[:-1] - s.at[:-1], n)
    out[where] = s.data
    return out, padded.tolist()


def _read(media: list[bytes]) -> list[tuple[list, list]]:
    """Images and thumbnails of each stored form; they are decoded some at a time."""
    images = [jpeg.parse(x) for x in media]
    every = [im for own in images for im in own]
    planes: list = []
    i = 0
    while i < len(every):
        j, size = i + 1, every[i].bytes
        while j < len(every) and size + every[j].bytes <= BLOCK:
            size += every[j].bytes
            j += 1
        planes += jpeg.dc_planes(every[i:j])
        i = j
    left = iter(planes)
    return [(own, [next(left) for _ in own]) for own in images]


def thumbnails(rows: DataFrame, *, media_col="media") -> DataFrame:
    """`rows` with width, height (of the first image), thumbnail (its DC luminance) and feature of each stored JPEG.

    A null value gives nulls. One that is not whole baseline JPEG gives nulls too, and error says why; nothing is allocated
    for images that their bytes cannot hold. Equal values give equal columns, and an empty table an empty one. These
    columns replace those of `rows` with their names; other names do not matter.
    """

    def make():
        def f(media):
            out = []
            for x in media.to_pylist():
                if x is None:
                    out.append((None, None, None, None, None))
                    continue
                try:
                    ((images, planes),) = _read([x])
                    out.append((images[0].width, images[0].height, planes[0].tobytes(), jpeg.feature(images, planes), None))
                except ValueError as e:
                    out.append((None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            return [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]

        return f

    return append(rows, media_col, make, "width int, height int, thumbnail binary, feature string, error string")


def digests(docs: DataFrame, *, text_col="text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without `drop`, with what a stored payload yields when it is read back, without keeping the stored form itself.

    n_bytes and payload_bytes long, payload_sha256 string and tail_crc32 long of the bytes read back, media_bytes long and
    media_sha256 string of the stored form, feature string. Null texts are empty. Equal texts give equal values, and an
    empty table gives an empty one. These columns replace those of `docs` with their names; other names do not matter. A
    long text is coded and read back image by image.
    """

    def make():
        def f(texts):
            out = []
            for s in slices(texts, BLOCK):
                media = jpeg.encode(*_payload(s))
                for n, m, (images, planes) in zip(np.diff(s.at).tolist(), media, _read(media), strict=True):
                    back = b"".join(p.tobytes() for p in planes)
                    out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), jpeg.feature(images, planes)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)]

        return f

    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return append(docs, text_col, make, columns, drop)
