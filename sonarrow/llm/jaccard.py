"""N-gram Jaccard join of texts, exact, by universe partitions (see partition.py for the signatures).

1. Each text becomes its set of word shingles; rows of equal sets are one vertex from here on.
2. Sets that share a signature are candidates. In each such group all sets are compared with the one that shares most
   signatures with others, which in a family of near copies is the text they come from.
3. Links make components. Groups that still hold sets of several components have their sets compared with the one that
   shares most outside the first one's component, and last pair by pair across components, block by block, until no pair
   is left untested.
4. Every row gets the least id of its component, or one row of each component is kept.

Parity sketches, an exact lower bound of the difference, come first and leave few pairs for which whole sets are sent.
Sets of one component need no further comparison, so a group of thousands of near copies costs about as many
comparisons as it has members. Shingles are computed again for sets in such pairs only and never held for all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import append, column, tidy
from .components import components
from .partition import Signer
from .shingles import close_pairs, least_difference, parity, set_hash, sets
from .staging import Stage
from .words import U64

#: Rows of one or two numbers up to which a table is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Slices, a power of two, in which all signatures are shuffled one after another.
SLICES = 4
#: Bits of the bitmap that sieves signatures, at most (16 MB).
MOST_BITS = 1 << 27
#: Sets of a block in which pairs of a crowded group are compared.
BLOCK = 512
#: Pairs for each member beyond which a place is a crowd, and shingles taken at once into an incidence matrix.
CROWD, COLUMNS = 4, 8192


def _signed(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """`docs` (_id, _text) without texts: text_hash, n_shingles, set_id, parity, signatures. Empty sets have set_id null."""

    def make():
        signer = Signer(num, den)

        def f(texts):
            n, ids, odd, sigs = [], [], [], []
            for x in sets(texts, size):
                n.append(len(x))
                odd.append(parity(x).tobytes() if len(x) else None)
                ids.append(set_hash(x) if len(x) else None)
                sigs.append(signer(x).view(np.int64) if len(x) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            return [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]

        return f

    docs = docs.withColumn("text_hash", F.xxhash64("_text"))
    return append(docs, "_text", make, "n_shingles long, set_id long, parity binary, signatures array<long>", drop=("_text",))


def _sieved(rows: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(set_id, signature) of `rows` but for most of those that are none of the `n` signatures of `shared`.

    The sieve is a bitmap over the signatures' low bits, of fixed greatest size; a fuller one lets more rows through to
    the join that decides.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    low = F.col("signature").bitwiseAND(F.lit(bits - 1))
    parts = shared.select(F.shiftright(low, 15).alias("part"), low.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    sieve = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for part, bitmap in parts.groupBy("part").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        sieve[part] = np.frombuffer(bitmap, np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(sieve.ravel())

    def run(batches):
        sieve = held.value
        for b in batches:
            lists = b.column("signatures")
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).view(U64) & U64(bits - 1)
            ok = pa.array((sieve[x >> U64(3)] >> (x & U64(7)).astype(np.uint8)) & 1 == 1)
            ids = b.column("set_id").take(pc.list_parent_indices(lists).filter(ok))
            yield pa.RecordBatch.from_arrays([ids, flat.filter(ok)], names=["set_id", "signature"])

    return rows.select("set_id", "signatures").mapInArrow(tidy(run), "set_id long, signature long")


def _common(a: bytes, b: bytes) -> tuple[int, int]:
    """The sizes of intersection and union of two sets of hashes."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    z = np.concatenate([x, y])
    z.sort()
    both = int((z[1:] == z[:-1]).sum())
    return both, len(z) - both


def _kept(pairs: DataFrame, sets: DataFrame, column: str, num: int, den: int, test) -> DataFrame:
    """The pairs (a, b) whose sizes allow it and whose `column` of `sets` passes `test`."""
    side = lambda k: sets.select(F.col("set_id").alias(k), F.col(column).alias(f"s{k}"), F.col("n").alias(f"n{k}"))

    def run(batches):
        for t in batches:
            ok = [test(x.as_buffer(), y.as_buffer(), m, n) for x, y, m, n in zip(t.column("sa"), t.column("sb"), t.column("na").to_pylist(), t.column("nb").to_pylist(), strict=True)]
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    j = pairs.join(side("b"), "b").join(side("a"), "a")
    j = j.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "sa", "sb", "na", "nb")
    return j.mapInArrow(tidy(run), "a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""

    def test(x, y, m, n):
        return least_difference(np.frombuffer(x, U64), np.frombuffer(y, U64)) * (den + num) <= (m + n) * (den - num)

    return _kept(pairs, sketches, "parity", num, den, test)


def _similar(pairs: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their shingles."""

    def test(x, y, m, n):
        both, union = _common(x, y)
        return den * both >= num * union

    return _kept(pairs, shingles, "shingles", num, den, test)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each left set with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    values, column, count = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    twice = count > 1
    place = np.cumsum(twice) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    keep = twice[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(twice.sum()), COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        x[row[i:j], column[i:j] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _open(labelled: DataFrame) -> DataFrame:
    """The groups of `labelled` (signature, set_id, label) with several labels, their size k added.

    Of groups with the same members, told by two 64-bit hashes of these, one stays: near copies share many signatures.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "set_id")).alias(f"m{k}") for k in range(2)]
    groups = labelled.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k"), *marks).where("x < y")
    return labelled.join(groups.groupBy("k", "m0", "m1").agg(F.min("signature").alias("signature")).select("signature", "k"), "signature")


def _blocks(groups: DataFrame) -> DataFrame:
    """Groups (signature, set_id, label, k) of k members fall into blocks of about `BLOCK` by hash; a row for each two blocks."""
    g = groups.withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    g = g.withColumn("own", F.pmod(F.xxhash64("set_id", "signature"), F.col("blocks")).cast("int"))
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return g.select("signature", "set_id", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))


def _crossing(groups: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in groups (signature, set_id, label, k) that parities do not rule out.

    Where a place has more pairs than `CROWD` a member, a row (signature, null, null) says so instead. Rows of a place
    come one after another, so that many small groups cost one call and not one each.
    """
    g = _blocks(groups).join(shingles.select("set_id", "n", "parity"), "set_id").repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j")

    def one(t):
        size, label, left, ids = (np.array(t.column(c).to_pylist()) for c in ("n", "label", "left", "set_id"))
        sketches = [np.frombuffer(x, U64) for x in t.column("parity").to_pylist()]
        p, q = close_pairs(size, sketches, label, num, den)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            across = left[p] != left[q]
            p, q = p[across], q[across]
        if len(p) > CROWD * len(ids):
            return [(t.column("signature")[0].as_py(), None, None)]
        return [(None, int(x), int(y)) for x, y in zip(np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), strict=True)]

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            key = [np.array(rest.column(c)) for c in ("signature", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            out, at = [], 0
            for e in cuts.tolist():
                if e - at > 1:
                    out += one(rest.slice(at, e - at))
                at = e
            rest = rest.slice(at)
            yield table(out)
        if rest is not None and len(rest) > 1:
            yield table(one(rest))

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["signature", "a", "b"])

    return g.mapInArrow(tidy(run), "signature long, a long, b long")


def _crossing_large(groups: DataFrame, shingles: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets of different components in crowded groups (signature, set_id, label, k).

    Two blocks are compared in one place, all pairs at once by a product of incidence matrices; for any two components one
    link is returned.
    """
    g = _blocks(groups)
    g = g.join(shingles.select("set_id", "shingles"), "set_id")

    def compare(t):
        ids, labels, left = (np.array(t.column(c).to_pylist()) for c in ("set_id", "label", "left"))
        sets = [np.frombuffer(x.as_buffer(), U64) for c in t.column("shingles").chunks for x in c]
        size = np.array([len(x) for x in sets])
        alone = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        rows, cols = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(left), np.flatnonzero(~left))
        names, counts = np.unique(labels, return_counts=True)
        most = labels == names[counts.argmax()]  # pairs within the largest component need no comparison
        links = {}
        for r, c in ((rows[~most[rows]], cols), (rows[most[rows]], cols[~most[cols]])):
            if alone and len(r) and most[r[0]]:
                continue  # these pairs were compared the other way round
            both = _overlaps([sets[k] for k in r], [sets[k] for k in c]).astype(np.int64)
            ok = den * both >= num * (size[r][:, None] + size[c][None, :] - both)
            ok &= labels[r][:, None] != labels[c][None, :]
            for p, q in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                links.setdefault((labels[r[p]], labels[c[q]]), (ids[r[p]], ids[c[q]]))
        return pa.table({"a": pa.array([x for x, _ in links.values()], pa.int64()), "b": pa.array([x for _, x in links.values()], pa.int64())})

    return g.groupBy("signature", "i", "j").applyInArrow(compare, "a long, b long")


def _shared(rows: DataFrame, stage: Stage) -> DataFrame:
    """(signature, set_id) for all signatures that several sets of `rows` have."""
    each = rows.select("set_id", F.explode("signatures").alias("signature"))
    # slice by slice, so that the shuffle files of one are gone before the next begins
    slices = [f"shared{k}" for k in range(SLICES)]
    for k, name in enumerate(slices):
        own = each.where(F.col("signature").bitwiseAND(F.lit(SLICES - 1)) == k).groupBy("signature")
        part = stage.put(own.agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a < z").select("signature"), name)
        shared = shared.unionByName(part) if k else part
    n = shared.count()
    few = F.broadcast(shared) if n <= BROADCAST_ROWS else shared
    members = stage.put(_sieved(rows, shared, n).join(few, "signature").select("signature", "set_id").distinct(), "common")
    stage.drop(*slices)
    # how much a set has in common with others
    degree = members.groupBy("set_id").agg(F.count("*").alias("degree"))
    members = stage.put(members.join(degree, "set_id"), "members")
    stage.drop("common")
    return members


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the sets of each group of `members` (signature, set_id, degree) with its centre.

    The centre is the set of greatest degree, of those for which `may_be_centre` holds if there is such a column.
    """
    centre = F.struct("degree", "set_id")
    centre = F.max(F.when(F.col("may_be_centre"), centre) if "may_be_centre" in members.columns else centre)
    centres = members.groupBy("signature").agg(centre.getField("set_id").alias("centre"))
    pairs = members.join(centres, "signature").where("set_id != centre")
    return pairs.select(F.least("set_id", "centre").alias("a"), F.greatest("set_id", "centre").alias("b")).distinct()


def _connected(docs: DataFrame, id_col, text_col, shingle, similarity, stats) -> DataFrame:
    """(_id, text_hash, n_shingles, set_id, root) of each row; sets of one component have one root."""
    num, den = similarity
    stage = Stage(docs.sparkSession, "jaccard")
    rows = stage.put(_signed(docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")), shingle, num, den), "rows")
    members = _shared(rows, stage)
    in_groups = members.select("set_id").distinct()
    of = rows.where("set_id is not null").join(in_groups, "set_id", "left_semi")
    sketches = stage.put(of.groupBy("set_id").agg(F.min("n_shingles").alias("n"), F.min("parity").alias("parity"), F.min("text_hash").alias("text_hash")), "sketches")
    rows = stage.put(rows.drop("signatures", "parity"), "sets")
    stage.drop("rows")

    def shingles_of(ids: DataFrame, name: str) -> DataFrame:
        """(set_id, n, shingles) of the sets `ids`, computed again from one text each."""
        wanted = stage.put(sketches.join(ids, "set_id", "left_semi").select("text_hash"), f"{name}-wanted")
        texts = docs.select(column(text_col).alias("_text")).where("_text is not null").withColumn("text_hash", F.xxhash64("_text"))
        texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "text_hash", "left_semi")
        texts = texts.groupBy("text_hash").agg(F.first("_text").alias("_text"))

        def make():
            def f(column):
                x = list(sets(column, shingle))
                return [pa.array([set_hash(s) for s in x], pa.int64()), pa.array([len(s) for s in x], pa.int64()), pa.array([s.tobytes() for s in x], pa.binary())]

            return f

        return stage.put(append(texts, "_text", make, "set_id long, n long, shingles binary", drop=("_text", "text_hash")), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones of some pairs (a, b)."""
        maybe = stage.put(_possible(pairs, sketches, num, den), f"{name}-maybe")
        shingles = shingles_of(ends(maybe), f"{name}-shingles")
        links = stage.put(_similar(maybe, shingles, num, den), name)
        stage.drop(f"{name}-maybe", f"{name}-wanted", f"{name}-shingles")
        return links

    def labelled_by(label: DataFrame, name: str) -> DataFrame:
        """`members` with the component of each set."""
        label = label.select(F.col("vertex").alias("set_id"), "root")
        return stage.put(members.join(label, "set_id", "left").select("signature", "set_id", "degree", F.coalesce("root", "set_id").alias("label")), name)

    first = stage.put(_stars(members), "first-pairs")
    links = linked(first, "first")
    label = components(links, stage, "one")
    labelled = labelled_by(label, "one-labels")
    # groups of several components: their next centre lies outside the component of the first
    tops = labelled.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.struct("degree", "set_id", "label")).getField("label").alias("top")).where("x < y")
    tops = stage.put(tops.select("signature", "top"), "tops")
    done = tops.isEmpty()  # then all pairs that are left lie within components
    if not done:
        again = labelled.join(tops, "signature").withColumn("may_be_centre", F.col("label") != F.col("top"))
        second = stage.put(_stars(again).join(first, ["a", "b"], "left_anti"), "second-pairs")
        links = links.unionByName(linked(second, "second"))
        tested = first.unionByName(second)
        labelled = labelled_by(components(links, stage, "two"), "two-labels")
        counted = stage.put(_open(labelled.drop("degree")), "open")
        crossing = stage.put(_crossing(counted, sketches, num, den), "crossing")
        untested = crossing.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        crowds = stage.put(counted.join(crossing.where("a is null").select("signature").distinct(), "signature", "left_semi"), "crowds")
        shingles = shingles_of(ends(untested).unionByName(crowds.select("set_id")).distinct(), "last-shingles")
        more = stage.put(_similar(untested, shingles, num, den).unionByName(_crossing_large(crowds, shingles, num, den)), "more")
        label = components(links.unionByName(more), stage, "all")
    if stats is not None:
        stats |= {"rows": rows.count(), "members": members.count(), "sets": sketches.count(), "pairs": first.count(), "links": links.count()}
        stats |= {"second": 0, "open": 0, "untested": 0, "crowds": 0, "more": 0} if done else {"second": second.count(), "open": counted.count(), "untested": untested.count(), "crowds": crowds.count(), "more": more.count()}

    stage.drop("members", "sketches", "first-pairs", "first", "one-labels", "tops", "second-pairs", "second", "two-labels", "open", "crossing", "crowds", "last-shingles-wanted", "last-shingles", "more")
    root = rows.join(label, F.col("set_id") == F.col("vertex"), "left").withColumn("root", F.coalesce("root", "set_id"))
    return root.select("_id", "text_hash", "n_shingles", "set_id", "root")


def join_components(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3, similarity=(90, 100), stats: dict | None = None) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id (the least id reachable over links, its own included).

    Rows link when den * |intersection| >= num * |union| for similarity (num, den) of at least 4/5. Rows of one set are
    linked; a null text and one without words have an empty set and are linked with nothing. A null id is a row whose
    component has the least id of the others, or null. Rows of equal id stay apart. An empty table gives an empty one.
    Other columns of `docs`, whatever their names, are not read. Long texts are shingled in parts; a task holds the word
    hashes of its longest text. Sets and shingles are told apart by 64-bit hashes.
    """
    rows = _connected(docs, id_col, text_col, shingle, similarity, stats)
    # a written table, so that a component that holds a third of all rows can be split in the join
    least = Stage(docs.sparkSession, "least").put(rows.where("root is not null").groupBy("root").agg(F.min("_id").alias("component_id")), "least")
    found = rows.join(least, "root", "left")
    return found.select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3, similarity=(90, 100)) -> DataFrame:
    """`docs` with one row of each component: that of the least id, then text hash. Rows with an empty set all stay.

    A null id comes after all others. Of rows that agree in id and text one stays; which one's other columns are kept is
    not defined. An empty table gives an empty one. The columns of `docs` may have any names. Long texts are shingled in
    parts; a task holds the word hashes of its longest text. The rows to go are fewer than those to stay, and texts are
    not shuffled while the former's keys may be broadcast.
    """
    stage = Stage(docs.sparkSession, "one")
    rows = _connected(docs, id_col, text_col, shingle, similarity, None).where("root is not null")
    keys = stage.put(rows.groupBy("root", "_id", "text_hash").agg(F.count("*").alias("times")), "times")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "text_hash")).alias("first")
    first = stage.put(keys.groupBy("root").agg(first), "first")  # written, so that a large component can be split in the join
    keys = stage.put(keys.join(first, "root").withColumn("stays", F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("text_hash") == F.col("first.text_hash"))), "keys")
    marked = keys.where("not stays or times > 1").select("_id", F.col("text_hash").alias("_hash"), "stays")
    few = marked.count() <= BROADCAST_ROWS
    # the rows themselves are one column, so that no name of theirs can be mistaken for one of these
    own = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("hash"), column(text_col).isNotNull().alias("has_text"))
    side = F.broadcast(marked) if few else marked
    joined = own.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & F.col("has_text"), "left")
    once = joined.where("stays is null").select("row.*")
    repeated = joined.where("stays").dropDuplicates(["_id", "_hash"]).select("row.*")
    return once.unionByName(repeated)
