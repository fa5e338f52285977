"""The pipeline's stages, each on what the one before it kept."""

import random
import re

from pyspark.sql import functions as F

from sonarrow.llm.staging import Stage

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("th er on ing of ou ly an".split()) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(30, 200))]
        bad = i % 6 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), "vilemoron")
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        if i % 12 < 6:
            labels.append((i, 1, int(bad)))
    docs += [(1000 + i, docs[1][1] + " tail", "en", "s0", 0) for i in range(5)] + [(1010, None, "en", "s1", 0), (1011, "", None, None, 0), (1012, "1234 !!", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stage, now, kept = Stage(spark, "t"), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, f in cp.STAGES:
        new = stage.put(f(spark, now, str(tmp_path)), name)
        if name != "packing":
            assert new.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = [r.doc_id for r in new.collect()]
        now = new
    clean = {i for i, t, *_ in docs if i < 240 and "vilemoron" not in t}
    assert set(kept["toxicity"]) & set(range(240)) == clean
    assert set(kept["language"]) == clean | set(range(1000, 1005))
    assert set(kept["near_duplicates"]) == clean and len(kept["near_duplicates"]) == len(clean)
    assert set(kept["mixing"]) <= clean and max(map(kept["mixing"].count, set(kept["mixing"]))) <= 2
    packed = now.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(kept["mixing"]) and all(r.n == r.t * kept["mixing"].count(r.doc_id) for r in packed)
    assert cp.run(spark, str(tmp_path)).count() == now.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE int, row int, `a.b` int"


def odd_corpus():
    """Documents with every odd input: null ids, texts, languages and sources, empty and long texts, repeated rows, clashing names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("th er on ing of ou ly an sch ung".split()) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(8, 120))]
        if i % 6 == 0:
            w[3:3] = ["vilemoron"] * 3
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0, 1, 2, 3))
        labels.append((i, int(i % 6 == 0)))
    for i in range(1, 40, 4):  # near copies: one word changed
        w = docs[i][1].split(" ")
        w[-1] = "changed"
        docs.append((500 + i, " ".join(w), "en", "s1", 0, 1, 2, 3))
    docs += [docs[7], docs[7], (7, docs[8][1], "en", "s0", 0, 1, 2, 3)]  # repeated rows; an id with two texts
    docs += [(None, docs[9][1], "en", "s0", 0, 1, 2, 3), (None, "only here " * 40, "en", None, None, None, None, None)]
    docs += [(900, None, "en", "s0", 0, 1, 2, 3), (901, "", "en", "s0", 0, 1, 2, 3), (902, "12 ?! 3", None, None, 0, 1, 2, 3), (903, "a", "en", "s0", 0, 1, 2, 3)]
    docs += [(904, " ".join(word() for _ in range(160_000)), "en", "s2", 0, 1, 2, 3)]  # over half a MB
    return docs, labels + [(None, 1), (77, None), (12345, 1)]


def shingles(text):
    w = W.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_copies_kept(rows):
    """By all pairs: of each class of linked texts the (id, text) of least id, then of least text hash; all without words."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    classes = {}
    for i, s in enumerate(sets):
        classes.setdefault(find(i) if s else ("alone", i), []).append(i)
    return classes


def test_odd_inputs(spark, tmp_path):
    """Each stage on a corpus of odd inputs, against its operator's or its own rule in plain Python."""
    import corpus_pipeline as cp

    from sonarrow.llm import langid, toxicity

    docs, labels = odd_corpus()
    d = spark.createDataFrame(docs, SCHEMA).repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, stage = str(tmp_path), Stage(spark, "t")
    key = lambda r: str((r.doc_id, r.text, r.lang, r.source, r.SCORE, r.row, r["a.b"]))

    kept = stage.put(cp.drop_toxic(spark, d, sf), "toxicity")
    model = toxicity.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    by = {r.text: r.s for r in toxicity.score(d.select("text"), model, out="s").collect()}
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in d.collect() if by[r.text] < 0.5)
    assert not any("vilemoron" in (r.text or "") for r in kept.collect()) and kept.where("doc_id in (900, 901, 904)").count() == 3
    assert kept.columns == d.columns

    known = stage.put(cp.known_language(spark, kept, sf), "language")
    model = langid.fit(kept)
    by = {r.text: r.rejected for r in langid.predict(kept.select("text"), model).collect()}
    assert sorted(map(key, known.collect())) == sorted(key(r) for r in kept.collect() if not by[r.text])
    assert known.where("text is null or text = '' or doc_id = 902").count() == 0

    one = stage.put(cp.one_of_near_copies(spark, known, sf), "near")
    rows = [(r.doc_id, r.text) for r in known.collect()]
    classes = near_copies_kept(rows)
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert len(left) == len(classes) and len(classes) < len(rows) - 10
    for members in classes.values():
        own = [rows[i] for i in members]
        (stays,) = [x for x in left if x in own]
        assert stays[0] == min((i for i, _ in own if i is not None), default=None)

    mixed = stage.put(cp.mix_sources(spark, one, sf), "mixing")
    assert mixed.columns == d.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= set(left)
    packed = cp.pack_windows(spark, mixed, sf).collect()
    assert sum(r.length for r in packed if r.doc_id is not None) == sum(r.doc_tokens for r in packed if r.start == 0 and r.doc_id is not None)
    assert sum(r.start == 0 for r in packed) == mixed.count()


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    d = spark.createDataFrame([], SCHEMA)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = Stage(spark, "t")
    for name, f in cp.STAGES[:-1]:
        d = stage.put(f(spark, d, str(tmp_path)), name)
        assert d.count() == 0 and d.columns == ["doc_id", "text", "lang", "source", "n_chars", "SCORE", "row", "a.b"]
    assert cp.run(spark, str(tmp_path)).count() == 0
