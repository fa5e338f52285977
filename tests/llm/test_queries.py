"""The numbered queries and the pipeline through the entry module, against plain Python and DuckDB."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text, lang, source from documents").fetchall()


def run(spark, start):
    (name,) = [n for n in entry.queries() if n.startswith(start)]
    df = entry.queries()[name](spark, SF)
    return df.dtypes, df.collect()


def words(t):
    return W.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("start", ["op1_", "op4_", "op13_"])
def test_sql(spark, duck, start):
    dtypes, rows = run(spark, start)
    (sql,) = [s for n, s in entry.oracle_sql().items() if n.startswith(start)]
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    want = r.fetchall()
    assert sorted(names) == sorted(n for n, _ in dtypes)
    key = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    assert sorted(key([r[n] for n in names]) for r in rows) == sorted(map(key, want))


def test_op1(spark, docs):
    dtypes, rows = run(spark, "op1_")
    assert dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    size = {i: len(W.findall(t or "")) for i, t, _, _ in docs}
    assert {r.doc_id: r.size for r in rows} == size and all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, "op1_")[1]))


def test_op2(spark, docs, duck):
    dtypes, rows = run(spark, "op2_")
    assert dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert sorted(r.doc_id for r in rows) == sorted(i for i, *_ in docs)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = dict(duck.execute("select doc_id, toxic from labels").fetchall())
    by = {r.doc_id: r.predicted for r in rows}
    assert np.mean([by[i] == y for i, y in toxic.items() if i in by]) > 0.9


def test_op3(spark, docs):
    dtypes, rows = run(spark, "op3_")
    assert dtypes[:8] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_op5(spark, docs):
    dtypes, rows = run(spark, "op5_")
    assert dtypes[:7] == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    c = collections.Counter()
    for i, t, *_ in docs:
        if crc(i) % 5 != 1:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in rows}
    for i, t, *_ in docs:
        x, r = [*words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 5 == 1, len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_op6(spark, duck):
    dtypes, rows = run(spark, "op6_")
    assert dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    ids, x = zip(*duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall(), strict=True)
    ids, x = np.array(ids), np.array(x, np.float32).astype(float)
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.query_id][r["rank"]] = r.vec_id
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)
    hits = 0
    for q in ids[ids % 20 == 0]:
        order = [int(ids[j]) for j in np.lexsort((ids, -(x @ x[ids == q][0]))) if ids[j] != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({*order} & {*got[q].values()})
    assert hits >= 0.9 * 20 * int((ids % 20 == 0).sum())


def test_op7(spark, docs):
    dtypes, rows = run(spark, "op7_")
    assert dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    lang = {i: (t, x) for i, t, x, _ in docs}
    assert len(rows) == len(docs)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in lang[r.doc_id][0] or "")) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id][1] for r in rows if r.held_out and lang[r.doc_id][1]]) > 0.9


def test_op8(spark, docs):
    import public_tokenizers

    from sonarrow.llm import viterbi

    dtypes, rows = run(spark, "op8_")
    assert dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("best_score", "double")]
    u = viterbi.load(public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: u.solve("▁" + t.replace(" ", "▁")) if t else (0, 0.0) for i, t, *_ in docs}
    assert {r.doc_id: (r.n_tokens, r.best_score) for r in rows} == want


def test_op9(spark, docs):
    dtypes, rows = run(spark, "op9_")
    assert dtypes[:3] == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    sets = {}
    for i, t, *_ in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_op10(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    dtypes, rows = run(spark, "op10_")
    assert dtypes[:7] == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in docs}
    at, used = collections.defaultdict(int), collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and sum(used.values()) > 0.9 * 2048 * (len(used) - 8)


def test_pipeline(spark):
    dtypes, rows = run(spark, "pipeline")
    assert [n for n, _ in dtypes] == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and rows


def test_op11(spark, duck):
    _, rows = run(spark, "op11_")
    vectors = dict(duck.execute("select vec_id, embedding from embeddings").fetchall())
    x = {i: [math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for i, v in vectors.items()}
    n, s = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    y = np.array([[(n * a - b) / n for a, b in zip(x[i], s, strict=True)] for i in sorted(x)])
    e, u = np.linalg.eigh(y.T @ y / n)
    white = []
    for k in range(8):
        own = sorted((r for r in rows if r.component == k + 1), key=lambda r: r.vec_id)
        assert [r.deviation for r in own] == [sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True)) for r in own]
        white.append([r.whitened for r in own])
        np.testing.assert_allclose(np.abs(white[-1]), np.abs(y @ u[:, -1 - k] / np.sqrt(e[-1 - k])), atol=1e-7)
        assert {round(r.explained / (e[-1 - k] / e.sum()), 9) for r in own} == {1.0}
    assert np.abs(np.cov(white, bias=True) - np.eye(8)).max() < 1e-9 and rows[0].identity_error < 1e-9


def test_op12(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    _, rows = run(spark, "op12_")
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, *_ in docs}
    want = {i: (len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(docs)
