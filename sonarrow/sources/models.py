"""Model files as rows: ggml and GGUF containers of named tensors, their parameters, filters and vocabulary.

A row is (path, kind, name, dtype, shape, value): kind is hparam, filters, token or tensor; value holds the bytes as stored
(hparams: a little-endian 32-bit integer). Quantized tensors stay quantized until `dequantized` is asked for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, kind string, name string, dtype int, shape array<long>, value binary, error string"

# Fixed values of the formats: parameter names in file order, block bytes of 32 values by stored type.
HPARAMS = "n_vocab n_audio_ctx n_audio_state n_audio_head n_audio_layer n_text_ctx n_text_state n_text_head n_text_layer n_mels ftype".split()
BLOCK_BYTES = {2: 18, 3: 20, 6: 22, 7: 24, 8: 34}
GGML, GGUF = 0x67676D6C, 0x46554747
#: GGUF value types by number: struct formats of the scalars, then string and array.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY, ALIGN = 8, 9, 32


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        b = self.data[self.at : self.at + n]
        if len(b) < n:
            raise ValueError("the file is cut off")
        self.at += n
        return b

    def span(self, n: int):
        """The next n bytes, as a reader gives large values."""
        return self.take(n)

    def number(self, form: str = "i"):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def end(self) -> bool:
        return self.at >= len(self.data)

    def gguf_string(self) -> bytes:
        return self.take(self.number("Q"))

    def gguf_value(self, kind: int):
        if kind == STRING:
            return self.gguf_string()
        if kind == ARRAY:
            inner, n = self.number("I"), self.number("Q")
            return [self.gguf_value(inner) for _ in range(n)]
        if kind not in SCALARS:
            raise ValueError(f"unknown metadata type {kind}")
        return self.number(SCALARS[kind])


def size_of(dtype: int, n: int, name: str) -> int:
    if dtype in (0, 1):
        return n * (4, 2)[dtype]
    if dtype not in BLOCK_BYTES:
        raise ValueError(f"tensor {name}: unsupported type {dtype}")
    if n % 32:
        raise ValueError(f"tensor {name}: {n} values are no whole blocks")
    return n // 32 * BLOCK_BYTES[dtype]


def _tensors(r: _Reader):
    while not r.end():
        n_dims, n_name, dtype = r.number(), r.number(), r.number()
        dims = [r.number() for _ in range(n_dims)]
        name = r.take(n_name).decode("utf-8", "replace")
        yield "tensor", name, dtype, dims[::-1], r.span(size_of(dtype, int(np.prod(dims)), name))


def parse(data: bytes, vad: bool = False, architecture: str | None = None) -> list[tuple]:
    """(kind, name, dtype, shape, value) of a file; the container is told by its first four bytes.

    A GGUF file of another architecture than the one asked for is refused.
    """
    return parsed(_Reader(data), vad, architecture)


def parsed(r: _Reader, vad: bool = False, architecture: str | None = None) -> list[tuple]:
    magic = r.number("I") if not r.end() else None
    if magic == GGUF:
        return list(_gguf(r, architecture))
    if magic != GGML:
        raise ValueError("neither ggml nor GGUF")
    whole = lambda k, v: ("hparam", k, 0, [], struct.pack("<i", v))
    if vad:
        out = [("hparam", "model_type", 0, [], r.take(r.number()))]
        out += [whole(f"version_{i}", r.number()) for i in range(3)]
        out += [whole(k, r.number()) for k in ("window_size", "context_size")]
        n = r.number()
        if n != 4:
            raise ValueError(f"{n} encoder layers; 4 are supported")
        out += [whole(f"layer_{i}_{k}", r.number()) for i in range(n) for k in ("in", "out", "kernel")]
        out += [whole(k, r.number()) for k in ("lstm_input_size", "lstm_hidden_size", "final_in", "final_out")]
        return out + list(_tensors(r))
    hp = {k: r.number() for k in HPARAMS}
    out = [whole(k, v) for k, v in hp.items()]
    n_mel, n_bins = r.number(), r.number()
    out.append(("filters", "mel", 0, [n_mel, n_bins], r.span(4 * n_mel * n_bins)))
    n = r.number()
    words = [r.take(r.number()) for _ in range(n)] + [f"[_extra_token_{i}]".encode() for i in range(n, hp["n_vocab"])]
    out += [("token", str(i), 0, [i], w) for i, w in enumerate(words)]
    return out + list(_tensors(r))


def _gguf(r: _Reader, architecture: str | None):
    version, n_tensors, n_keys = r.number("I"), r.number("Q"), r.number("Q")
    if version not in (2, 3):
        raise ValueError(f"GGUF version {version}")
    meta = {}
    for _ in range(n_keys):
        key = r.gguf_string().decode("utf-8", "replace")
        meta[key] = r.gguf_value(r.number("I"))
    if architecture is not None and meta.get("general.architecture") != architecture.encode():
        raise ValueError("another architecture")
    for k in HPARAMS:
        found = [v for key, v in meta.items() if key.endswith("." + k)]
        if not found:
            raise ValueError(f"no {k}")
        yield "hparam", k, 0, [], struct.pack("<i", found[0])
    for i, w in enumerate(meta.get("tokenizer.ggml.tokens", [])):
        yield "token", str(i), 0, [i], w
    infos = []
    for _ in range(n_tensors):
        name = r.gguf_string().decode("utf-8", "replace")
        dims = [r.number("Q") for _ in range(r.number("I"))]
        infos.append((name, dims[::-1], r.number("I"), r.number("Q")))
    align = meta.get("general.alignment", ALIGN)
    start = -(-r.at // align) * align
    for name, shape, dtype, offset in infos:
        r.at = start + offset
        value = r.span(size_of(dtype, int(np.prod(shape)), name))
        yield ("filters", "mel", 0, shape, value) if name == "mel_filters" else ("tensor", name, dtype, shape, value)


def stored(dtype: int, length: int) -> tuple[int, int]:
    """Type and bytes of a tensor in a GGUF file: half precision is widened."""
    return (0, 2 * length) if dtype == 1 else (dtype, length)


def gguf_head(hparams: dict[str, bytes], tokens: list[bytes], tensors: list[tuple[str, int, list[int], int]], architecture: str = "speech") -> tuple[bytes, dict[str, int]]:
    """Everything before the tensors' bytes, and the place of each in the file; `tensors` are (name, dtype, shape, bytes)."""
    text = lambda s: struct.pack("<Q", len(s)) + s
    keys = [(b"general.architecture", STRING, text(architecture.encode())), (b"general.alignment", 4, struct.pack("<I", ALIGN))]
    keys += [(f"{architecture}.{n}".encode(), 5, v) for n, v in hparams.items()]
    keys.append((b"tokenizer.ggml.tokens", ARRAY, struct.pack("<IQ", STRING, len(tokens)) + b"".join(map(text, tokens))))
    head = struct.pack("<IIQQ", GGUF, 3, len(tensors), len(keys)) + b"".join(text(k) + struct.pack("<I", t) + v for k, t, v in keys)
    places, at = {}, 0
    for name, dtype, shape, length in sorted(tensors):
        dtype, length = stored(dtype, length)
        head += text(name.encode()) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape[::-1], dtype, at)
        places[name] = at
        at += length + -length % ALIGN
    head += bytes(-len(head) % ALIGN)
    return head, {k: len(head) + v for k, v in places.items()} | {"": len(head) + at}


def gguf_bytes(dtype: int, value: bytes) -> bytes:
    return np.frombuffer(value, "<f2").astype("<f4").tobytes() if dtype == 1 else value


def to_gguf(rows: list[tuple], architecture: str = "speech") -> bytes:
    """A GGUF file of parsed rows: tensors by name, 32-byte alignment, half precision widened, quantized blocks as they are."""
    tensors = {("mel_filters" if kind == "filters" else n): (t, s, v) for kind, n, t, s, v in rows if kind in ("tensor", "filters")}
    tokens = [v for kind, n, _, _, v in sorted((x for x in rows if x[0] == "token"), key=lambda x: int(x[1]))]
    head, places = gguf_head({n: v for kind, n, _, _, v in rows if kind == "hparam"}, tokens, [(n, t, s, len(v)) for n, (t, s, v) in tensors.items()], architecture)
    out = bytearray(places[""])
    out[: len(head)] = head
    for n, (t, _, v) in tensors.items():
        v = gguf_bytes(t, v)
        out[places[n] : places[n] + len(v)] = v
    return bytes(out)


def dequantized(dtype: int, value: bytes) -> np.ndarray:
    """The numbers of a stored tensor: x = d * q + m, q of 4, 5 or 8 bits in blocks of 32."""
    if dtype in (0, 1):
        return np.frombuffer(value, ("<f4", "<f2")[dtype]).astype(np.float32)
    raw = np.frombuffer(value, np.uint8).reshape(-1, BLOCK_BYTES[dtype])
    half = lambda a, b: np.ascontiguousarray(raw[:, a:b]).view("<f2").astype(np.float32)
    d = half(0, 2)
    if dtype == 8:
        return (raw[:, 2:].view(np.int8) * d).ravel()
    at = 2 + 2 * (dtype in (3, 7))
    high = np.zeros((len(raw), 32), np.int64)
    if dtype in (6, 7):
        word = np.ascontiguousarray(raw[:, at : at + 4]).view("<u4").astype(np.int64)
        high = (word >> np.arange(32)) & 1
        at += 4
    q = np.concatenate([raw[:, at:] & 15, raw[:, at:] >> 4], axis=1) + 16 * high
    if dtype in (3, 7):
        return (q * d + half(2, 4)).astype(np.float32).ravel()
    return ((q - (8 if dtype == 2 else 16)) * d).astype(np.float32).ravel()


@F.arrow_udf(T.ArrayType(T.FloatType()))
def numbers(dtype: pa.Array, value: pa.Array) -> pa.Array:
    """The numbers of stored tensors, block by block; null for a null, an unknown type and a value that is not whole blocks."""
    out = []
    for t, v in zip(dtype.to_pylist(), value.to_pylist(), strict=True):
        size = {0: 4, 1: 2, **BLOCK_BYTES}.get(t)
        out.append(None if v is None or not size or len(v) % size else dequantized(t, v))
    return pa.array(out, pa.list_(pa.float32()))


def read(spark: SparkSession, path: str, vad: bool = False, architecture: str | None = None) -> DataFrame:
    """Rows of SCHEMA for all files under `path`; a file that cannot be read is one row with its error."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = [(file, *x, None) for x in parse(content, vad, architecture)]
                except (ValueError, struct.error) as e:
                    rows = [(file, None, None, None, None, None, str(e))]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string())
                names = ["path", "kind", "name", "dtype", "shape", "value", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
