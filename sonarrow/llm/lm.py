"""Language-model scoring by class-based n-grams, and by a smoothed unigram as the base.

P(w_i | w_{i-1}) = P(class_i | class_{i-1}) * P(w_i | class_i). Every word of the training text gets its class by exchange:

1. every word's count, as a table by word hash in the shared folder; its size grows with the text;
2. the `FREQUENT` most frequent words are exchanged until none moves, on the driver, over their bigrams; all other words
   are one more unit there, in a class of its own;
3. `ROUNDS` rounds of distributed exchange: a pass counts, for each further word, the classes of its neighbours, and each
   word goes to the class of greatest gain while the others stay. Neighbours that are not among the `HEAD` most frequent
   words count as of the class of all others, whose words are never moved into it; so their own classes count nowhere
   before the last round, and they are placed in it;
4. a last pass counts class bigrams, those of words beyond the head included;
5. scores: words of the head are looked up in the task, the others are joined with the table of counts and classes.

Transitions are smoothed by the classes' shares, emissions like the base: (c + 0.5) / (tokens + 0.5 (words + 1)) in a
class, the last one for all unseen words. An unseen word has no class: its probability is summed over classes, and what
follows it is told by the classes' shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import append, column, others, tidy
from .brown import exchange, gains
from .staging import Stage
from .words import U64, finder, mix64, slices, spans, word_hashes

#: Words looked up in tasks; words exchanged on the driver; classes, the first of which is the end's; weight of the classes' shares.
HEAD, FREQUENT, CLASSES, SMOOTH = 1 << 18, 1022, 64, 20.0
#: Rounds of exchange over all further words.
ROUNDS = 2
#: Of neighbours: the class of words that have none yet or are not looked up; of words: not seen in training.
REST = UNSEEN = CLASSES
#: Slots of a word's context: what follows it by class, what stands before it by class, itself.
BEFORE, OWN, SLOTS = CLASSES + 1, 2 * (CLASSES + 1), 2 * (CLASSES + 1) + 1
#: The hashes that stand for the end of a text and for class bigrams, and the bins per doubling in which counts are looked through.
END, GRID, BINS = 0x656E64, 0x67726964, 64
#: Rows that a task holds before it hands them on.
HELD = 1_000_000


def _tokens(texts):
    """For some texts at a time: the word hashes of all, and how many each text has. Long texts are read in parts."""
    before: list[np.ndarray] = []
    for s in slices(texts, parts=True):
        s = s.lower()
        begins, ends, n = spans(s)
        h = word_hashes(s.data, begins, ends)
        if s.more:
            before.append(h)
            continue
        if before:
            h, before = np.concatenate([*before, h]), []
            n = np.array([len(h)])
        yield h, n


def _with_ends(x: np.ndarray, n: np.ndarray, end) -> np.ndarray:
    """`x` of all texts with `end` after each text."""
    out = np.full(len(x) + len(n), end, x.dtype)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = x
    return out


def _summed(docs: DataFrame, count, other: bool = False) -> DataFrame:
    """Rows (word, slot, n), or (word, slot, other, n), that `count()` finds in the texts of `docs` (_text), added up in the tasks and then over all."""
    keys = {"word": pa.int64(), "slot": pa.int16(), **({"other": pa.int64()} if other else {})}

    def run(batches):
        found = count()
        held: list[tuple] = []
        size = 0

        def merged():
            *key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            # by word, and in it by slot: rows that share these bits of other words are told apart below, equal ones left apart add up later
            order = np.argsort((key[0] & ~U64(255)) | (sum(k.astype(U64) for k in key[1:]) & U64(255)))
            key = [k[order] for k in key]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            return *(k[first] for k in key), np.add.reduceat(n[order], first) if len(first) else n

        def out(*x):
            return pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64) if v.dtype == U64 else v, t) for v, t in zip(x, keys.values(), strict=False)), pa.array(x[-1], pa.int64())], names=[*keys, "n"])

        for b in batches:
            for part in found(b.column("_text")):
                held.append(part)
                size += len(part[0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())

    ddl = ", ".join(f"{k} {'short' if t == pa.int16() else 'long'}" for k, t in keys.items()) + ", n long"
    return docs.select("_text").mapInArrow(tidy(run), ddl).groupBy(*keys).agg(F.sum("n").alias("n"))


def _counted(word: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, slot) pairs and how often each is there."""
    u, inverse = np.unique(word, return_inverse=True)
    pair, n = np.unique(inverse * SLOTS + slot, return_counts=True)
    return u[pair // SLOTS], (pair % SLOTS).astype(np.int16), n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts of `docs` (_text): hashes, with the end as a word of its own."""

    def count():
        def f(texts):
            for h, n in _tokens(texts):
                u, c = np.unique(h, return_counts=True)
                yield np.append(u, U64(END)), np.zeros(len(u) + 1, np.int16), np.append(c, len(n))

        return f

    return _summed(docs, count).select("word", F.col("n").alias("c"))


@dataclass
class Model:
    """What scoring needs in every task; sizes are bounded by HEAD and CLASSES."""

    words: np.ndarray  # the head's hashes, ascending
    counts: np.ndarray  # their counts
    classes: np.ndarray  # their classes; REST: none yet
    frequent: np.ndarray  # whether they are the end or exchanged on the driver
    tokens: int
    distinct: int
    transition: np.ndarray | None = None  # log10, from class to class; the last row is for after an unseen word
    share: np.ndarray | None = None  # log10 of the denominator of a class's emissions
    unseen: np.ndarray | None = None  # log10 of the probability of an unseen word after each class


def unit_pairs(docs: DataFrame, m: Model) -> DataFrame:
    """(pair, n): counts of unit after unit, as first * units + second; a text begins after an end, unit 0.

    Frequent words are units by place in the head, all other words are the last unit.
    """
    number = np.cumsum(m.frequent & (m.words != U64(END)))
    unit = np.where(m.frequent, np.where(m.words == U64(END), 0, number), FREQUENT + 1).astype(np.int16)
    units = FREQUENT + 2
    held = docs.sparkSession.sparkContext.broadcast((m.words, unit))

    def run(batches):
        words, unit = held.value
        look = finder(words)
        total = np.zeros(units * units, np.int64)
        for t in batches:
            for h, n in _tokens(t.column("_text")):
                at, found = look(h)
                u = _with_ends(np.where(found, unit[at], units - 1) if len(unit) else np.full(len(h), units - 1), n, 0).astype(np.int64)
                pair, c = np.unique(np.append(0, u[:-1]) * units + u, return_counts=True)
                total[pair] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    return docs.select("_text").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def contexts(docs: DataFrame, m: Model, beyond: bool, head_alone: bool = False) -> DataFrame:
    """(word, slot, n): the neighbours by class of all words that are not frequent; with `head_alone`, of those of the head.

    With `beyond`, (word, slot, other, n) of words beyond the head alone, and `other` is the word that follows where that
    is one of them too. The word GRID has the class bigrams of all text, as pairs of slots.
    """
    held = docs.sparkSession.sparkContext.broadcast((m.words, m.classes.astype(np.int16), m.frequent))

    def count():
        words, classes, frequent = held.value
        look = finder(words)
        none = lambda n: [np.zeros(n, np.int64)] if beyond else []

        def f(texts):
            for h, n in _tokens(texts):
                at, found = look(h)
                c = np.where(found, classes[at], REST) if len(words) else np.full(len(h), REST)
                wanted = ~found if beyond or not len(words) else ~(found & frequent[at])
                if head_alone:
                    wanted &= found
                h, c, wanted = _with_ends(h, n, U64(END)), _with_ends(c, n, 0).astype(np.int64), _with_ends(wanted, n, False)
                before, last = np.append(U64(END), h[:-1]), np.append(0, c[:-1])
                grid, k = np.unique(last * BEFORE + c, return_counts=True)
                yield np.full(len(grid), U64(GRID)), grid.astype(np.int16), *none(len(grid)), k
                same = before == h
                w = np.flatnonzero(wanted)
                into, out = w[~same[w]], w[~same[w + 1]] + 1  # an end is never wanted, so each has a next
                if beyond:
                    pairs = out[c[out] == REST]
                    into, out = into[last[into] != REST], out[c[out] != REST]
                    if len(pairs):
                        yield h[pairs - 1], np.full(len(pairs), REST, np.int16), h[pairs].view(np.int64), np.ones(len(pairs), np.int64)
                word, slot, k = _counted(np.concatenate([h[into], h[out - 1], h[w[same[w]]]]), np.concatenate([BEFORE + last[into], c[out], np.full(int(same[w].sum()), OWN)]))
                yield word, slot, *none(len(word)), k

        return f

    return _summed(docs, count, other=beyond)


def _grid(found: DataFrame) -> np.ndarray:
    """The class bigrams of a table of contexts."""
    rows = found.where(F.col("word") == GRID).select("slot", "n").toArrow()  # a cell of the grid each
    grid = np.zeros(BEFORE * BEFORE)
    grid[np.array(rows.column("slot"), np.int64)] = np.array(rows.column("n"))
    return grid.reshape(BEFORE, BEFORE)


def _gathered(batches, rows: int):
    """The batches of a task as tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def assigned(found: DataFrame, m: Model, grid: np.ndarray) -> DataFrame:
    """(word, class): the class of greatest gain for each word of `found`; a word of the head leaves its own only for more."""
    lists = found.where(F.col("word") != GRID).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("at"))  # SLOTS at most
    held = found.sparkSession.sparkContext.broadcast((m.words, m.classes, grid))

    def run(batches):
        words, classes, grid = held.value
        look = finder(words)
        for t in _gathered(batches, HELD // 16):
            lists = t.column("at").combine_chunks()
            to, cells = lists.offsets.to_numpy().astype(np.int64), lists.values
            slot, n = cells.field("slot").to_numpy().astype(np.int64), cells.field("n").to_numpy()
            word = t.column("word").to_numpy().view(U64)
            at, known = look(word)
            now = np.where(known, classes[at], REST).astype(np.int64) if len(words) else np.full(len(word), REST)
            # words of one class with the same counts, as most rare ones are, have one best class
            alike = np.add.reduceat(mix64(n.astype(U64) << U64(8) | slot.astype(U64)), to[:-1]) + mix64(now.astype(U64))
            _, some, which = np.unique(alike, return_index=True, return_inverse=True)
            best = np.zeros(len(some), np.int16)
            for i in range(0, len(some), 2048):
                w = some[i : i + 2048]
                size, own, row = to[w + 1] - to[w], now[w], np.arange(len(w))
                cell = np.arange(int(size.sum())) + np.repeat(to[w] - np.cumsum(size) + size, size)
                table = np.zeros((len(w), SLOTS))
                table[np.repeat(row, size), slot[cell]] = n[cell]
                g = gains(grid, table[:, :BEFORE], table[:, BEFORE:OWN], table[:, OWN], own)[:, 1:CLASSES]
                top = g.argmax(1) + 1
                stay = own != REST
                mine = g[row, np.where(stay, own - 1, 0)]
                top[stay] = np.where(g.max(1) > mine + 1e-6 * np.abs(mine), top, own)[stay]
                best[i : i + 2048] = top
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(best[which])], names=["word", "class"])

    return lists.mapInArrow(tidy(run), "word long, class short")


def _into_head(m: Model, classes: DataFrame) -> None:
    """The classes of words of the head, HEAD rows at most, go into the model."""
    head = classes.select("word", "class").toArrow()
    at, found = finder(m.words)(np.array(head.column("word"), np.int64).view(U64))
    m.classes = m.classes.copy()
    m.classes[at[found]] = np.array(head.column("class"))[found]


def train(docs: DataFrame, stage: Stage) -> tuple[Model, DataFrame]:
    """The model of all texts of `docs` (_text), and the table (word, c, class, in_head) of all its words."""
    counts = stage.put(word_counts(docs), "counts")
    bin_of = F.floor(F.log2(F.col("c").cast("double")) * BINS)
    binned = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect()  # BINS for each doubling of a count
    least, room = None, HEAD
    for bin_, n in sorted(((r[0], r[1]) for r in binned), reverse=True):
        if n > room:
            break
        least, room = bin_, room - n
    in_head = (bin_of >= (least if least is not None else 1 << 40)) | (F.col("word") == END)
    total = counts.groupBy().agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.where(in_head).toArrow()  # HEAD rows and the end at most
    word, c = np.array(head.column("word"), np.int64).view(U64), np.array(head.column("c"), np.int64)
    order = np.argsort(word)
    word, c = word[order], c[order]
    frequent = word == U64(END)
    by_count = np.lexsort((word, -c))
    frequent[by_count[~frequent[by_count]][:FREQUENT]] = True
    m = Model(word, c, np.where(word == U64(END), 0, REST).astype(np.int16), frequent, int(total[0]), int(total[1]))

    got = unit_pairs(docs, m).toArrow()
    units = FREQUENT + 2
    pairs = np.zeros(units * units)
    pairs[np.array(got.column("pair"), np.int64)] = np.array(got.column("n"))
    fixed = np.full(units, -1)
    fixed[0], fixed[-1] = 0, REST
    m.classes[frequent & (word != U64(END))] = exchange(pairs.reshape(units, units), CLASSES + 1, fixed)[1 : int(frequent.sum()) + 1 - int((word == U64(END)).sum())]

    known = counts.select("word", "c", in_head.alias("in_head"))
    for k in range(ROUNDS):
        final = k == ROUNDS - 1
        found = stage.put(contexts(docs, m, beyond=False, head_alone=not final), f"contexts{k}")
        classes = assigned(found, m, _grid(found))
        if final:  # before it, a class of a word beyond the head would count nowhere
            classes = stage.put(classes.join(known, "word"), "classes")
        _into_head(m, classes.where("in_head") if final else classes)
        stage.drop(f"contexts{k}")

    found = stage.put(contexts(docs, m, beyond=True), "beyond")
    grid = _grid(found)
    last = found.where(F.col("word") != GRID).join(classes.select("word", "class"), "word")
    last = last.join(classes.select(F.col("word").alias("other"), F.col("class").cast("int").alias("next")), "other", "left").select("class", F.coalesce("next", "slot").alias("slot"), "n")
    last = last.groupBy("slot", "class").agg(F.sum("n").alias("n")).toArrow()  # SLOTS x CLASSES at most
    for slot, own, n in zip(*(x.to_pylist() for x in (last.column("slot"), last.column("class"), last.column("n"))), strict=True):
        if slot < REST:
            grid[own, slot] += n
        elif slot == OWN:
            grid[own, own] += n
        else:
            grid[slot - BEFORE, own] += n
    grid = grid[:CLASSES, :CLASSES]
    arrived = grid.sum(0)
    part = (arrived + 0.5) / (arrived + 0.5).sum()
    transition = (grid + SMOOTH * part[None, :]) / (grid.sum(1)[:, None] + SMOOTH)
    transition = np.concatenate([transition, part[None]])
    own = np.zeros((CLASSES, 2))
    np.add.at(own, m.classes[frequent], np.stack([c[frequent], np.ones(int(frequent.sum()))], axis=1))
    for k, n, words in classes.groupBy("class").agg(F.sum("c"), F.count("*")).collect():
        own[k] += n, words
    denominator = own[:, 0] + 0.5 * (own[:, 1] + 1)
    m.transition, m.share, m.unseen = np.log10(transition), np.log10(denominator), np.log10(transition @ (0.5 / denominator))
    return m, classes


def _table(x: np.ndarray) -> Column:
    """A matrix as one constant array, row by row."""
    return F.split(F.lit(",".join(map(repr, x.ravel().tolist()))), ",").cast("array<double>")


def score(docs: DataFrame, m: Model, words: DataFrame, stage: Stage, *, text_col="text") -> DataFrame:
    """`docs` with n_tokens, n_known, base_score and score; see `lm_scores`."""
    held = docs.sparkSession.sparkContext.broadcast(m)

    def make():
        model = held.value
        log_c = np.log10(model.counts + 0.5) if len(model.counts) else np.zeros(1)
        classes = model.classes if len(model.classes) else np.zeros(1, np.int16)
        look = finder(model.words)
        at, found = look(np.array([END], U64))
        end_known = bool(found[0])
        end_log = float(log_c[at[0]]) if end_known else float(np.log10(0.5))

        def f(texts):
            cols: list[list] = [[], [], [], []]
            rare: list[tuple] = []
            for h, n in _tokens(texts):
                at, found = look(h)
                text = np.repeat(np.arange(len(n)), n)
                own = _with_ends(np.where(found, classes[at], -1).astype(np.int64), n, 0)
                before = np.append(0, own[:-1])
                both = (own >= 0) & (before >= 0)
                link = np.where(own >= 0, -model.share[own], 0.0) + np.where(both, model.transition[before, own], 0.0)
                first = np.cumsum(n + 1) - (n + 1)
                cols[0].append(n + 1)
                cols[1].append(np.bincount(text, found, len(n)).astype(np.int64) + end_known)
                cols[2].append(np.bincount(text, np.where(found, log_c[at], 0.0), len(n)) + end_log)
                cols[3].append(np.add.reduceat(link, first))
                w = np.flatnonzero(own < 0)  # with what stands before and after them, -1 if that is not of the head either
                place = np.cumsum(_with_ends(np.ones(len(h), np.int64), n, 0)) - 1
                rare.append((h[place[w]].view(np.int64), w - np.repeat(first, n + 1)[w], before[w], own[w + 1], np.bincount(text[place[w]], minlength=len(n))))
            cat = lambda x, d: np.concatenate(x).astype(d) if x else np.zeros(0, d)
            parts = [cat([r[k] for r in rare], np.int64) for k in range(5)]
            at = pa.array(np.concatenate([[0], np.cumsum(parts[4])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in zip(parts[:4], (pa.int64(), pa.int32(), pa.int16(), pa.int16()), strict=True)]
            return [pa.array(cat(c, d)) for c, d in zip(cols, (np.int64, np.int64, float, float), strict=True)] + lists

        return f

    names = "n_tokens n_known train_tokens base_score score".split()
    kept = docs.select(*map(column, others(docs, [*names, text_col])))
    row = F.struct(*map(column, kept.columns)) if kept.columns else F.lit(0)
    source = docs.select(row.alias("row"), column(text_col).alias("text"))  # names of `docs` cannot be mistaken for these
    added = "tokens long, known long, seen double, links double, word array<long>, place array<int>, before array<short>, after array<short>"
    part = stage.put(append(source, "text", make, added, drop=("text",)).withColumn("number", F.monotonically_increasing_id()), "parts")
    rare = part.select("number", F.inline(F.arrays_zip("word", "place", "before", "after"))).join(words.where("not in_head").select("word", "c", "class"), "word", "left")
    # an unseen word is of class UNSEEN; words beyond the head that follow one another meet in a window over their text
    own = F.coalesce(F.col("class").cast("int"), F.lit(UNSEEN))
    last = F.lag("own").over(Window.partitionBy("number").orderBy("place"))
    rare = rare.withColumn("own", own).withColumn("from", F.when(F.col("before") >= 0, F.col("before").cast("int")).otherwise(last))
    at = lambda table, i: F.element_at(table, (i + 1).cast("int"))
    seen = F.col("own") < CLASSES
    arrival = F.when(seen, at(_table(m.transition), F.col("from") * CLASSES + F.col("own")) + F.log10(F.col("c") + 0.5) - at(_table(m.share), F.col("own"))).otherwise(at(_table(m.unseen), F.col("from")))
    departure = F.when(F.col("after") >= 0, at(_table(m.transition), F.col("own") * CLASSES + F.col("after"))).otherwise(0.0)
    rare = rare.select("number", "c", (arrival + departure).alias("links"))
    rare = rare.groupBy("number").agg(F.sum("links").alias("more_links"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("also"))
    rare = rare.withColumnRenamed("number", "_number")
    words_sum = F.col("seen") + F.coalesce("more", F.lit(0.0))
    base = words_sum - F.col("tokens") * float(np.log10(m.tokens + 0.5 * (m.distinct + 1)))
    return part.join(rare, F.col("number") == F.col("_number"), "left").select(
        *([F.col("row.*")] if kept.columns else []),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("seen") + F.col("links") + F.coalesce("more_links", F.lit(0.0))).alias("score"),
    )


def lm_scores(docs: DataFrame, train_if: Column, *, text_col="text") -> DataFrame:
    """`docs` without its texts, with n_tokens, n_known, train_tokens long and base_score, score double of each text.

    The model is of the rows for which `train_if` holds. Tokens are words and an end for each text; null texts are empty,
    the end alone. Rows are scored one by one: repeated ones get equal scores, and an empty table gives an empty one.
    Without training rows every token is unknown. A computed column replaces one of `docs` with its name; other names do
    not matter. Long texts are read in parts; a task holds the word hashes of its longest text. Perplexity is
    10 ** (-score / n_tokens).
    """
    stage = Stage(docs.sparkSession, "lm")
    model, words = train(docs.where(train_if).select(column(text_col).alias("_text")), stage)
    stage.drop("counts", "beyond")
    return score(docs, model, words, stage, text_col=text_col)
