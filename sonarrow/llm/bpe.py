"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the tokens finds the longest one that starts at each place. From the front the longest is
taken that may follow the token before it; where none may, the last token is taken back and a shorter one tried, and the
place where nothing fits is never come to again, so the work is linear in the text. Two tokens may stand side by side if
taking back their merges, the latest first, never shows a pair at the border that merges would have joined before; such
answers are kept in a pair table. There is one way only to cut a text into tokens of which all neighbours may stand side
by side, and that is what merging by rank gives.

Normalizing and cutting into words is the tokenizer file's own affair and left to its library; the chunks between ASCII
white space are encoded once or seldom. Decoding gathers the tokens' bytes by their places in one array.
"""

from __future__ import annotations

import json
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import append
from .chunks import Memory
from .words import U64, Slice, hashes, mix64, slices, spans

#: Bits of the number of answers that the pair table keeps; a newer one takes an older one's place.
PAIRS = 18
#: Answers that are kept besides for words encoded one by one.
KNOWN = 1 << 14
#: Chunks that are cut into words at once; words that are encoded one by one when so few go on; ids decoded at once.
BATCH, FEW, IDS = 4096, 32, 1 << 16
NEVER = 1 << 62


def _letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Encodes words under {token: id}, merges in order of rank, and an end-of-word suffix.

    A word is a sequence of symbols, its last one with the suffix; a symbol is a code point here, the suffixed ones in a
    plane of their own, so that a token is a string of as many characters as it has symbols. Many words are encoded at once.
    """

    APART, GAP = 1 << 16, "\U0010ffff"

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        import ahocorasick

        self.suffix, self.n = suffix, max(ids.values(), default=-1) + 1
        self.rank = np.full(self.n, -1, np.int64)
        self.left, self.right = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.size, self.shorter = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        for rank, (a, b) in enumerate(merges):
            whole = ids[a + b]
            if self.rank[whole] >= 0:
                raise ValueError("a token has more than one merge")
            self.left[whole], self.right[whole], self.rank[whole] = ids[a], ids[b], rank
        made = np.flatnonzero(self.rank >= 0)
        pairs = self.left[made] * self.n + self.right[made]
        order = np.argsort(pairs)
        self.pairs, self.joined = pairs[order], self.rank[made][order]
        self.known: dict[tuple[int, int], bool] = {}
        self.answers = np.full(1 << PAIRS, -1, np.int64)  # of pairs: twice the pair's number, and one more if it fits
        # a token that its own merges do not lead to is never the result, nor part of one
        whole = np.ones(self.n, bool)
        whole[made] = self._free(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            whole[t] &= whole[self.left[t]] & whole[self.right[t]]
        name = {s: i for t, i in ids.items() if whole[i] and (s := self.symbols(t)) and (self.rank[i] >= 0 or len(s) == 1)}
        self.automaton = ahocorasick.Automaton()
        for s, i in name.items():
            self.size[i] = len(s)
            self.shorter[i] = next((name[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in name), -1)
            self.automaton.add_word(s, i)
        if name:
            self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        """A token's symbols; with a suffix the last one is moved to the plane of suffixed ones."""
        if self.suffix and token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + self.APART) if token else ""
        return token

    def _free(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no pair at the border of a and b is joined before `limit`, and then before the merge last taken back."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            pair = a * self.n + b
            at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            hit = (self.pairs[at] == pair) & (self.joined[at] < limit) if len(self.pairs) else np.zeros(len(a), bool)
            out[live[hit]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb  # the later merge is taken back; of equal pairs the first is joined first
            go = ~hit & (first | (rb >= 0))
            first, a, b = first[go], a[go], b[go]
            limit = np.where(first, ra[go], rb[go] + 1)
            a, b, live = np.where(first, self.right[a], a), np.where(first, b, self.left[b]), live[go]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a, from the pair table where it has the answer."""
        pair = a * self.n + b
        slot = (mix64(pair.view(U64)) >> U64(64 - PAIRS)).astype(np.int64)
        found = self.answers[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            ask, back = np.unique(pair[new], return_inverse=True)
            found[new] = (2 * ask + self._free(ask // self.n, ask % self.n, np.full(len(ask), NEVER)))[back]
            self.answers[slot[new]] = found[new]
        return (found & 1).astype(bool)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has; characters without a token are an error."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.suffix:
            words = [w[:-1] + chr(ord(w[-1]) + self.APART) if w else w for w in words]
        text = self.GAP.join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lens + 1) - lens - 1
        longest = np.full(len(text) + 1, -1, np.int64)
        if text:
            match = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            longest[match[:, 0] + 1 - self.size[match[:, 1]]] = match[:, 1]  # the last of each place is the longest
        here = np.ones(len(text) + 1, bool)
        here[first + lens] = False
        if (longest[here] < 0).any():
            raise ValueError("a character has no token")
        return self._cut(longest, first, first + lens)

    def _cut(self, longest: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, shorter = self.size, self.shorter
        last = np.full(len(longest), -1, np.int64)  # the token that ends at a place
        dead = np.zeros(len(longest), bool)
        live = np.flatnonzero(first < stop)
        at, begin, end = first[live], first[live], stop[live]
        token = longest[at]
        while len(at):
            if len(at) < FEW:
                for i in range(len(at)):
                    self._one(longest, last, dead, int(begin[i]), int(end[i]), int(at[i]), int(token[i]))
                break
            to = at + size[token]
            ok = (token >= 0) & ~dead[np.minimum(to, end)]
            after = np.flatnonzero(ok & (at > begin))
            ok[after] = self.fits(last[at[after]], token[after])
            back = token < 0  # nothing fits here
            dead[at[back]] = True
            last[to[ok]] = token[ok]
            top = last[at]
            token = np.where(ok, longest[np.where(ok, to, at)], shorter[np.where(back, top, token)])
            at = np.where(ok, to, np.where(back, at - size[top], at))
            if (done := at == end).any():
                at, begin, end, token = at[~done], begin[~done], end[~done], token[~done]
        ends = np.zeros(len(longest), bool)
        place, begin = stop, first
        while len(place := place[go := place > begin]):
            begin = begin[go]
            ends[place] = True
            place = place - size[last[place]]
        ends = np.flatnonzero(ends)
        return last[ends], np.diff(np.searchsorted(ends, np.append(first, len(longest)), "right"))

    def _one(self, longest, last, dead, begin: int, end: int, at: int, token: int) -> None:
        """The rest of one word, for the few that are longer than all others."""
        longest, size, shorter, known = longest[begin : end + 1].tolist(), self.size, self.shorter, self.known
        out, at, end = last[begin : end + 1].tolist(), at - begin, end - begin
        gone = bytearray(dead[begin : begin + end + 1].tobytes())
        while at < end:
            if token < 0:
                gone[at] = 1
                token = out[at]
                at -= int(size[token])
                token = int(shorter[token])
                continue
            to = at + int(size[token])
            ok = not gone[to]
            if ok and at:
                pair = out[at], token
                ok = known.get(pair)
                if ok is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    ok = known[pair] = bool(self.fits(np.array([pair[0]]), np.array([token]))[0])
            if ok:
                out[to], at, token = token, to, longest[to]
            else:
                token = int(shorter[token])
        last[begin : begin + end + 1] = out


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Codec:
    """A tokenizers file of kind BPE over bytes: chunks of text to ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = _file(path)
        model, added = file["model"], file.get("added_tokens", [])
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-pair models are encoded")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens must stand for themselves, in the text as it is")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        # the library's normalizer and pre-tokenizer, without its model
        tokenizer = Tokenizer.from_str(json.dumps({**file, "added_tokens": [], "post_processor": None, "model": {**model, "vocab": {}, "merges": []}}))
        self.normalizer, self.words = tokenizer.normalizer, tokenizer.pre_tokenizer

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                words = [w for w, _ in self.words.pre_tokenize_str(self._normal(part))]
                out += self.merges.encode(words)[0].tolist()
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks without white space, for pre-tokens that never go over it: they are cut into words together."""
        out: list = [None] * len(chunks)
        plain = []
        for i, c in enumerate(chunks):
            if (self.cut and self.cut.search(c)) or len(c.split()) != 1:
                out[i] = self.encode(c)
            else:
                plain.append(i)
        for i in range(0, len(plain), BATCH):
            some = plain[i : i + BATCH]
            text = self._normal(" ".join([chunks[k] for k in some]))
            blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
            if len(blanks) != len(some) - 1:  # the normalizer makes or takes away blanks
                for k in some:
                    out[k] = self.encode(chunks[k])
                continue
            words = self.words.pre_tokenize_str(text)
            ids, n = self.merges.encode([w for w, _ in words])
            of = np.searchsorted(blanks, np.fromiter((o[0] for _, o in words), np.int64, len(words)))
            ends = np.cumsum(np.bincount(of, n, len(some)).astype(np.int64)).tolist()
            ids = ids.tolist()
            for k, a, b in zip(some, [0, *ends], ends, strict=False):
                out[k] = ids[a:b]
        return out


class Offsets:
    """The bytes of all tokens of a file one after another, and where each id's begin."""

    def __init__(self, path: str):
        file = _file(path)
        decoder = file.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError("only files with no decoder or one of bytes are decoded")
        self.blank, byte = decoder is None, {c: bytes([b]) for b, c in _letters().items()}
        ids = file["model"]["vocab"] | {a["content"]: a["id"] for a in file.get("added_tokens", [])}
        text = {i: t.encode() if self.blank else b"".join(byte.get(c) or c.encode() for c in t) for t, i in ids.items()}
        known = [text.get(i) for i in range(max(text, default=-1) + 1)]
        self.known = np.array([x is not None for x in known], bool)
        self.data = np.frombuffer(b"".join((x or b"") + (b" " if self.blank else b"") for x in known), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x or b"") + self.blank for x in known])]).astype(np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of lists of ids, list k between at[k] and at[k + 1]; unknown ids are left out."""
        ok = (ids >= 0) & (ids < len(self.known))
        ok[ok] = self.known[ids[ok]]
        at = np.concatenate([[0], np.cumsum(ok)])[at]
        ids = ids[ok]
        n = self.at[ids + 1] - self.at[ids]
        after = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(after[-1])
        place += np.repeat(self.at[ids] - after[:-1], n)
        raw = self.data[place].tobytes()
        ends = after[at].tolist()
        if self.blank:  # no blank after the last token
            return [raw[a : max(a, b - 1)] for a, b in pairwise(ends)]
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in pairwise(ends)]


_MEMORY: dict[str, Memory] = {}


def _memory(path: str, chunks_apart: bool) -> Memory:
    key = f"{path} {chunks_apart}"
    if key not in _MEMORY:
        codec = Codec(path)
        text = lambda chunks: [c.decode("utf-8", "replace") for c in chunks]
        _MEMORY[key] = Memory((lambda chunks: codec.encode_chunks(text(chunks))) if chunks_apart else (lambda chunks: [codec.encode(t) for t in text(chunks)]))
    return _MEMORY[key]


def _path(tokenizer: str | None) -> str:
    if tokenizer is None:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    return tokenizer


def _whole(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = np.diff(s.at) > 0
    return s.at[:-1][full], s.at[1:][full], full.astype(np.int64)


def encode(docs: DataFrame, *, tokenizer: str | None = None, white_space_apart: bool = True, text_col="text", out="ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without `drop`, with the token ids (array<int>) of each whole text; null and empty texts have none.

    `tokenizer` is the path of a tokenizers file of a byte-level BPE, on every executor. No special tokens are added; those
    that the text holds become their ids. `white_space_apart` says that no pre-token goes over ASCII white space, as in
    the default file: texts are then read chunk by chunk, long ones in parts; else each distinct text is encoded whole.
    Equal texts get equal ids, and an empty table gives an empty one. `out` replaces a column of `docs` with its name;
    other names do not matter. A task holds the ids of a batch of texts, and some times its longest chunk.
    """
    path = _path(tokenizer)

    def make():
        memory = _memory(path, white_space_apart)

        def f(texts):
            values, lens, open_ = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
            for s in slices(texts, parts=white_space_apart):
                begins, ends, n = spans(s) if white_space_apart else _whole(s)
                ids, per = memory.flat(memory.look(s.data, begins, ends, hashes(s.data, begins, ends)))
                values.append(ids)
                after = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(n)])]
                if s.more:
                    open_ += len(ids)
                    continue
                got = np.diff(after)
                got[0] += open_
                open_ = 0
                lens.append(got)
            at = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).astype(np.int32)))]

        return f

    return append(docs, text_col, make, f"`{out}` array<int>", drop)


def decode(df: DataFrame, *, tokenizer: str | None = None, ids_col="ids", out="decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` without `drop`, with the text of each list of ids, special tokens included; a null list gives null.

    Null ids and ids that the file does not have are left out. `out` replaces a column of `df` with its name; other names
    do not matter.
    """
    path = _path(tokenizer)

    def make():
        table = Offsets(path)

        def f(lists):
            lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lens)])
            flat, null, out = lists.flatten(), lists.is_null().to_numpy(zero_copy_only=False), [pa.array([], pa.binary())]
            i = 0
            while i < len(lists):  # about IDS ids at a time; a longer list is alone
                j = max(i + 1, int(np.searchsorted(at, at[i] + IDS, "right")) - 1)
                ids = flat.slice(at[i], at[j] - at[i]).fill_null(-1).to_numpy(zero_copy_only=False)
                out.append(pa.array(table.decode(ids, at[i : j + 1] - at[i]), pa.binary(), mask=null[i:j]))
                i = j
            return [pa.concat_arrays(out).view(pa.string())]

        return f

    return append(df, ids_col, make, f"`{out}` string", drop)
