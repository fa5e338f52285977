"""Token counts without tokens: the best segmentation's score and number of pieces under a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary's pieces enumerates every match of a chunk of text, by end; for each end the
best score so far and its number of pieces are kept, no path. Ties follow the tokenizer: of several best ways to reach an
end the one whose last piece starts first stays. Where no piece of one character covers a character, an unknown piece of
score min - 10 may; it counts as its UTF-8 bytes with byte fallback, else a run of unknown ones as one.

White space becomes U+2581, with one before the text. No piece of the vocabulary has U+2581 after another character, so
the best segmentation never goes over such a place: texts are cut there and each distinct chunk is solved once or seldom.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import append
from .chunks import Memory
from .words import Slice, hashes, slices

MARK = "▁"
PENALTY = 10.0


class Unigram:
    """Best segmentation under {piece: score}, with sums in double precision from the front, as the tokenizer has them."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        import ahocorasick

        self.byte_fallback, self.unknown = byte_fallback, min(scores.values()) - PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cuts = not any(MARK in p.lstrip(MARK) for p in scores)

    def solve(self, text: str) -> tuple[int, float]:
        """The number of pieces of the best segmentation and its score."""
        n = len(text)
        score, count, run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        end = 0
        for last, (length, s) in self.automaton.iter(text):
            while end < last:
                end += 1
                self._unknown(text, end, score, count, run)
            s += score[last + 1 - length]
            if score[last + 1] is None or s > score[last + 1]:
                score[last + 1], count[last + 1] = s, count[last + 1 - length] + 1
        while end < n:
            end += 1
            self._unknown(text, end, score, count, run)
        return count[n], score[n]

    def _unknown(self, text, end, score, count, run):
        """All matches that end here are in: now the unknown piece, which starts last of all."""
        c = text[end - 1]
        if c not in self.single:
            s = score[end - 1] + self.unknown
            if score[end] is None or s > score[end]:
                score[end], run[end] = s, True
                count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else not run[end - 1])


def load(path: str) -> Unigram:
    """The ordinary pieces of a sentencepiece file with their scores, byte fallback if it has byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Unigram({sp.id_to_piece(i): sp.get_score(i) for i in plain}, byte_fallback=any(sp.is_byte(i) for i in range(n)))


_LOADED: dict = {}


def _memory(path: str) -> tuple[Unigram, Memory]:
    if path not in _LOADED:
        model = load(path)

        _LOADED[path] = model, Memory(lambda chunks: [model.solve(c.decode("utf-8", "replace").replace(" ", MARK)) for c in chunks], np.float64)
    return _LOADED[path]


def _cut(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks: a run of spaces and what follows up to the next space. Each text of the slice begins with a space."""
    space = s.data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[s.at[:-1]] = True
    begins = np.flatnonzero(begins)
    return begins, np.append(begins[1:], len(s.data)), np.diff(np.searchsorted(begins, s.at))


def count_tokens(docs: DataFrame, *, vocabulary: str | None = None, text_col="text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without `drop`, with n_tokens long and best_score double of each whole text; null and empty texts have 0 tokens and score 0.

    `vocabulary` is the path of a sentencepiece file on every executor. Ties go as the tokenizer has them. A score is the
    sum over the text's chunks. Equal texts get equal values, and an empty table gives an empty one. These columns replace
    those of `docs` with their names; other names do not matter. A task holds some twenty times its longest text.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")

    def make():
        model, memory = _memory(vocabulary)

        def f(texts):
            tokens, best = [np.zeros(0, np.int64)], [np.zeros(0)]
            for s in slices(texts):
                n = np.diff(s.at)
                full = n > 0
                at = s.at + np.concatenate([[0], np.cumsum(full)])  # a space before each text
                data = np.full(int(at[-1]), 0x20, np.uint8)
                keep = np.ones(len(data), bool)
                keep[at[:-1][full]] = False
                data[keep] = s.data
                s = Slice(data, at, s.first)
                if model.cuts:
                    begins, ends, chunks = _cut(Slice(data, np.append(at[:-1][full], at[-1]), 0))
                    per = np.zeros(s.n, np.int64)
                    per[full] = chunks
                else:
                    begins, ends, per = at[:-1][full], at[1:][full], full.astype(np.int64)
                v, _ = memory.flat(memory.look(data, begins, ends, hashes(data, begins, ends)))
                text = np.repeat(np.arange(s.n), per)
                tokens.append(np.bincount(text, v[0::2], s.n).astype(np.int64))
                best.append(np.bincount(text, v[1::2], s.n))
            return [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(best))]

        return f

    return append(docs, text_col, make, "n_tokens long, best_score double", drop)
