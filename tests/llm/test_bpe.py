"""The backtracking encoder against the tokenizers library and against merging by rank, pair by pair."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonarrow.llm import bpe

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [None, "", " ", "\x0b\x0c ​ zero", "It's the été of Å and <|endoftext|> here<|startoftext|>", "<|endoftext|", "a b c\x85d\x1ce", "don't  stop\tnow\n\nI'LL 12345 !!! 中文 \U0001f600 ΑΣ İ",
         "x" * 70_000, "the of and " * 90_000, "́ alone", "aaaa aaaaaaa aaaaa", "\U0010ffff￾\x00"]


def by_rank(symbols: list[str], merges: dict) -> list[str]:
    """The definition: join the pair of least rank, the first of equal ones, until none can be joined."""
    while len(symbols) > 1:
        rank, at = min((merges.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == 1 << 30:
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


@given(st.randoms(use_true_random=False), st.text("ab", max_size=24), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_encoder_is_merging_by_rank(rng, word, n):
    tokens, merges = ["a", "b"], []
    while len(merges) < n:
        pair = rng.choice(tokens), rng.choice(tokens)
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    m = bpe.Merges({t: i for i, t in enumerate(tokens)}, merges)
    want = by_rank(list(word), {p: i for i, p in enumerate(merges)})
    for copies in (1, 2 * bpe.FEW):  # one by one, and together
        ids, lens = m.encode([word, "", "ab"] * copies)
        at = np.cumsum([0, *lens])
        cut = [[tokens[i] for i in ids[a:b]] for a, b in zip(at, at[1:], strict=False)]
        assert cut[0::3] == [want] * copies and cut[1::3] == [[]] * copies and {len(c) for c in cut[2::3]} <= {1, 2}


def test_repeated_merges_and_odd_files():
    with pytest.raises(ValueError):
        bpe.Merges({t: i for i, t in enumerate(["a", "aa", "aaa"])}, [("a", "a"), ("aa", "a"), ("a", "aa")])
    m = bpe.Merges({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    assert m.encode(["abab", ""])[0].tolist() == [2, 2] and m.encode([])[0].tolist() == []
    with pytest.raises(ValueError):
        m.encode(["a?"])
    m.known = dict.fromkeys(range(bpe.KNOWN), True)
    assert m.encode(["aab"])[0].tolist() == [0, 2] and len(m.known) < 9


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library(spark, path):
    tok = Tokenizer.from_file(path)
    rng = random.Random(4)
    names = list(tok.get_vocab())
    texts = TEXTS + ["".join(rng.choice(names).replace("</w>", rng.choice(["", " "])) for _ in range(40)) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(60)]
    rows = [(i if i else None, t, i) for i, t in enumerate(texts)] + [(5, texts[4], -1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, IDS int").repartition(3)
    got = bpe.decode(bpe.encode(d, tokenizer=path, white_space_apart=path == WORD), tokenizer=path).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "ids", "decoded"]
    for r in got:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tok.decode(want, skip_special_tokens=False), (r.text or "")[:50]


def test_long_texts_come_in_parts(spark):
    """Texts of several slices, one of them without white space."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gam'ma", "über."]) for _ in range(200_000)), "ab" * 600_000, ""]
    tok = Tokenizer.from_file(WORD)
    got = {r.k: r.ids for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == tok.encode(t, add_special_tokens=False).ids


def test_odd_ids(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 999_999, -4, 1])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(d).collect()} == {1: None, 2: "", 3: "! \""}
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_offsets():
    c = bpe.Offsets(BYTE)
    ids = np.array(Tokenizer.from_file(BYTE).encode("été and so on").ids)
    assert c.decode(ids, np.array([0, 2, 2, len(ids)]))[1] == b"" and b"".join(c.decode(ids, np.array([0, len(ids)]))).decode() == "été and so on"
