"""Packing and token counts against the tokenizers themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from sonarrow.llm import packing, viterbi

TEXTS = ["", None, " ", "It's the été of Å and <|endoftext|> here", "a b c\x85d\x1ce", "don't  stop\tnow\n\nI'LL 12345 !!! 中文 \U0001f600", "x" * 5000, "the of and " * 9000, "\x0b\x0c ​ zero"]


def documents(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["alpha", "Beta,", "gam'ma", "de", "über."]) for _ in range(rng.randrange(900)))) for i in range(80)]
    rows += [(5, "twin"), (5, "twin"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, 0, b"") for i, t in rows], "doc_id long, text string, start long, ids binary")


def test_pack(spark):
    rows, d = documents(spark)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in rows)
    got = packing.pack(d.repartition(3)).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= 2048
    docs = {}
    for r in got:
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    whole = []
    for (i, n), pieces in docs.items():
        copies = sum(p.length for p in pieces) // n
        starts = {}
        for p in pieces:
            starts.setdefault(p.start, []).append(p)
        assert all(len(v) == copies for v in starts.values())
        for c in range(copies):
            own = [v[c] for _, v in sorted(starts.items())]
            assert sum(p.length for p in own) == n
            whole.append((i, zlib.crc32(b"".join(bytes(p.ids) for p in own))))
    assert sorted(whole) == want
    total = sum(r.length for r in got)
    assert len(by_seq) <= total / 2048 * 1.05 + 3 + 3
    assert packing.pack(d.where("doc_id = -1")).count() == 0


@given(st.lists(st.integers(1, 256), min_size=1, max_size=120), st.integers(1, 12))
@settings(deadline=None, max_examples=60)
def test_differencing(sizes, k):
    sizes = np.array(sizes)
    window, loads = packing.differencing(sizes, k)
    assert (np.bincount(window, sizes, k).astype(int) == np.sort(loads)[::-1][: k][np.argsort(np.argsort(-np.bincount(window, sizes, k), kind="stable"), kind="stable")]).all() or sorted(np.bincount(window, sizes, k).astype(int)) == sorted(loads)
    assert loads.max() - loads.min() <= sizes.max()
    w, n = packing.windows(sizes, 300)
    assert np.bincount(w, sizes, n).max() <= 300 and n >= -(-sizes.sum() // 300)


def _hf(scores, byte_fallback):
    low = min(scores.values())
    vocab = [("<unk>", low - 1e6)] + list(scores.items())
    if byte_fallback:
        vocab += [(f"<0x{b:02X}>", low - 1e5) for b in range(256)]
    return Tokenizer(Unigram(vocab, 0, byte_fallback)), low - 1e6


@pytest.mark.parametrize("byte_fallback", [True, False])
@given(st.text("abéc ", max_size=30), st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.integers(-6, 0), min_size=2, max_size=14))
@settings(deadline=None, max_examples=150)
def test_ties(byte_fallback, text, scores):
    """Whole numbers make many ties; the unknown score is set as the tokenizer has it."""
    scores = {k: float(v) for k, v in scores.items()}
    hf, unk = _hf(scores, byte_fallback)
    u = viterbi.Unigram(scores, byte_fallback)
    u.unknown = min(unk, min(v for v in ([unk] + list(scores.values())))) - viterbi.PENALTY
    s = "▁" + text.replace(" ", "▁")
    assert u.solve(s)[0] == len(hf.encode(s).ids)


def test_count(spark):
    rows, d = documents(spark)
    u = viterbi.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = viterbi.count_tokens(d).collect()
    assert len(got) == len(rows)
    for r in got:
        n, s = u.solve("▁" + r.text.replace(" ", "▁")) if r.text else (0, 0)
        assert (r.n_tokens, r.best_score) == (n, s) and isinstance(r.best_score, float)
    assert viterbi.count_tokens(d.where("doc_id = -1")).count() == 0
    clash = spark.createDataFrame([("ab cd", 7, 7)], "text string, N_TOKENS int, best_score int")
    assert viterbi.count_tokens(clash).columns == ["text", "n_tokens", "best_score"]


def test_fractional_scores(spark, monkeypatch):
    """Scores that are no whole numbers, against all ways to cut a text into pieces."""
    scores = {"\u2581a": -1.25, "\u2581": -2.5, "a": -1.75, "b": -2.125, "ab": -3.0625, "\u2581ab": -3.5, "bb": -2.75}
    u = viterbi.Unigram(scores, byte_fallback=False)
    monkeypatch.setitem(viterbi._LOADED, "fractions", (u, viterbi.Memory(lambda chunks: [u.solve(c.decode().replace(" ", "\u2581")) for c in chunks], np.float64)))

    def best(s):
        return max([0.0] if not s else [v + best(s[len(p) :]) for p, v in scores.items() if s.startswith(p)])

    texts = ["ab", "abb ab", "bb aab", "", "a b"]
    memory = viterbi._LOADED["fractions"][1]
    for t in texts:
        assert u.solve(("\u2581" + t.replace(" ", "\u2581")) if t else "")[1] == pytest.approx(best(("\u2581" + t.replace(" ", "\u2581")) if t else ""))
    chunk = [b" ab", b" abb", b" ab"]
    data = np.frombuffer(b"".join(chunk), np.uint8)
    ends = np.cumsum([len(c) for c in chunk])
    number = memory.look(data, ends - [len(c) for c in chunk], ends, np.array([1, 2, 1], np.uint64))
    assert memory.flat(number)[0][1::2].tolist() == [best("\u2581ab"), best("\u2581abb"), best("\u2581ab")]


def test_memory_is_bounded():
    """What is dropped when the memory is full is computed again; values never depend on it."""
    calls = []

    def compute(chunks):
        calls.append(len(chunks))
        return [[len(c), *c] for c in chunks]

    from sonarrow.llm.chunks import Memory

    m, rng = Memory(compute, most_bytes=1 << 16), random.Random(5)
    for _ in range(60):
        chunks = [bytes(rng.choices(b"abcdefgh", k=rng.randrange(1, 6))) for _ in range(900)]
        ends = np.cumsum([len(c) for c in chunks])
        at = ends - [len(c) for c in chunks]
        h = np.array([zlib.crc32(c) for c in chunks], np.uint64)
        flat, n = m.flat(m.look(np.frombuffer(b"".join(chunks), np.uint8), at, ends, h))
        assert flat.tolist() == [x for c in chunks for x in (len(c), *c)] and n.tolist() == [1 + len(c) for c in chunks]
        assert m.bytes < 1 << 19
    assert sum(calls) > m.n


def test_long_texts_come_in_parts():
    """Texts of several slices: packing's ids and the language model's words are those of the whole texts, and none of a neighbour's."""
    import pyarrow as pa

    from sonarrow.llm import lm, words

    rng = random.Random(9)
    long = " ".join(rng.choice(["Alpha", "beta,", "gam'ma", "über.", "x" * 900]) for _ in range(12_000))
    texts = ["first one", long, None, long[:700_000].replace(" ", "\n"), "", "last"]
    assert max(len(t.encode()) for t in texts if t) > 3 * words.SLICE_BYTES
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {}
    for first, ids, at in packing._token_ids(pa.array(texts), path):
        got |= {first + i: ids[a:b].tolist() for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    found = []
    for h, n in lm._tokens(pa.array(texts)):
        ends = np.cumsum(n)
        found += [h[b - k : b].tolist() for b, k in zip(ends, n, strict=True)]

    def whole(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        s = words.Slice(data, np.array([0, len(data)]), 0).lower()
        begins, ends, _ = words.spans(s)
        return words.hashes(s.data, begins, ends).tolist()

    assert found == [whole(t) for t in texts]
