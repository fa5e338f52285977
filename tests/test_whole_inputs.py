"""Queries over whole inputs: long texts, apostrophes, tables of several files, against brute force."""

import random
from datetime import datetime, timedelta

from sonarrow.plans import catalog

LONG = ["the hello of 12 " * 300, "don't stop, it's 9 o'clock and we'll see\n\n  'twas " * 40, "Gr\u00fc\u00dfe \u4e16\u754c 7x8 'st " * 200, "a" * 450 + "'re 42", "short 1", "'", "  "]


def pieces(b):
    """Pre-tokens of bytes, one byte at a time."""
    space = b" \t\n\r\x0b\x0c"
    kind = lambda c: "l" if chr(c).isalpha() and c < 128 else "d" if 48 <= c < 58 else "s" if c in space else "o"
    out, i = [], 0
    while i < len(b):
        c = next((x for x in (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d") if b.startswith(x, i)), b"")
        at = i + (b[i] == 32)
        j = i + len(c)
        if not c and at < len(b) and kind(b[at]) != "s":
            j = at
            while j < len(b) and kind(b[j]) == kind(b[at]):
                j += 1
        elif not c:
            while j < len(b) and kind(b[j]) == "s":
                j += 1
            j = j if j == len(b) else max(i + 1, j - 1)
        out.append(b[i:j])
        i = j
    return out


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")


def test_pretokens_of_whole_texts(spark, tmp_path):
    documents(spark, tmp_path, LONG)
    got = {r.doc_id: (r.letters, r.digits) for r in catalog.QUERIES["pretokenize_counts_full"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(LONG):
        p = [x.removeprefix(b" ") for x in pieces(t.encode())]
        want[i] = (sum(x.isalpha() for x in p), sum(x.isdigit() for x in p))
    assert got == want and len(got) == len(LONG)


def test_greedy_encode_of_whole_texts(spark, tmp_path):
    words = [bytes([i]) for i in range(256)] + [w.encode() for w in ("he", "llo", "hello", " the", "the", " of", " and", "en", "er", "ch")]
    documents(spark, tmp_path, LONG)
    got = {r.doc_id: (r.n, r.checksum) for r in catalog.QUERIES["greedy_encode"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(LONG):
        n = s = 0
        for p in pieces(t.encode()):
            while p:
                k = max((k for k, w in enumerate(words) if p.startswith(w)), key=lambda k: len(words[k]))
                n, s, p = n + 1, (s * 31 + k) % 1000003, p[len(words[k]) :]
        want[i] = (n, s)
    assert max(len(t) for t in LONG) > 4000 and got == want


def ratio(b):
    """The estimate with every start within 1024 bytes tried."""
    cost, i = 12, 0
    while i < len(b):
        best = 0
        for s in range(max(0, i - 1024), i):
            n = 0
            while n < 255 and i + n < len(b) and b[s + n % (i - s)] == b[i + n]:
                n += 1
            best = max(best, n)
        cost, i = (cost + 4, i + best) if best >= 4 else (cost + 1, i + 1)
    return len(b) / cost if b else 1.0


def test_compression_ratio_of_whole_texts(spark, tmp_path):
    r = random.Random(3)
    noise = "".join(r.choice("abcdefgh é") for _ in range(1100))
    texts = [noise[:400] + "la " * 300, noise[:300] * 2, noise + noise[:200], noise[:1020] + noise[:60], noise[:1] * 3000, "abc", "", noise[:600] + noise[5:430], noise[:604] + noise[600:1025] + noise[:20]]
    texts += ["".join(r.choice("ab") for _ in range(1500))]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x.ratio for x in catalog.QUERIES["compression_ratio"](spark, str(tmp_path)).collect()}
    assert got == {i: round(ratio(t.encode()), 6) for i, t in enumerate(texts)}


def test_stream_windows_over_files_in_any_order(spark, tmp_path):
    r = random.Random(5)
    at = [i * 3600 * 24 * 30 // 400 for i in range(400)]
    r.shuffle(at)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=t), r.random() * 100) for i, t in enumerate(at)]
    for k, late in enumerate((3, 0, 2, 1)):  # files newest first, then oldest, each over a week, and one shuffled over the month
        some = sorted(rows[:300], key=lambda x: x[1])[75 * late : 75 * late + 75]
        spark.createDataFrame(some, "event_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(rows[300:], "event_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    key = lambda n: sorted((x.start_s, x.n, x.total) for x in catalog.QUERIES[n](spark, str(tmp_path)).collect())
    assert sum(x[1] for x in key("sliding_hop_window")) == 4 * len(rows)
    assert key("stream_windows") == key("sliding_hop_window")
