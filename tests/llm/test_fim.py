"""Fill-in-middle against the rule written out for one text, and round trips."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonarrow.llm import fim

#: A unit of each kind as a pattern; what comes before the first unit goes with it.
PATTERNS = {"char": r"(?s:.)", "word": r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", "line": r"[^\n]+\n*", "piece": r"(?:[!-/:-@\[-`{-~]|[^ \t\n\v\f\r!-/:-@\[-`{-~]+)[ \t\n\v\f\r]*"}


def rule(text, draw, unit="char", rate=90, first=20):
    begins = [m.start() for m in re.finditer(PATTERNS[unit], text)]
    n = len(begins)
    if not n or any(s in text for s in fim.SENTINELS) or draw[2] % 100 >= rate:
        return n, "plain", None, None, text
    place = lambda r: 0 if r == 0 else len(text) if r == n else begins[r]
    a, b = sorted((place(draw[0] % (n + 1)), place(draw[1] % (n + 1))))
    if draw[3] % 100 < first:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("unit", sorted(PATTERNS))
@given(st.text(st.sampled_from("aé\U0001f600 \n\t.<PSM>\x85"), max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
@settings(max_examples=150, deadline=None)
def test_rule(unit, text, draw):
    assert fim.transform(text, draw, fim.Scanner(unit)) == rule(text, draw, unit)


def draw_of(i, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


TEXTS = [None, "", "x", "<", "a <P> b", "<S", "ends with <", "é\U0001f600 中文\n\nline", "w " * 300_000, "<M>", "\x00\x01", "a\r\nb"]


@pytest.mark.parametrize("unit", sorted(PATTERNS))
def test_documents(spark, unit):
    rows = [(i, t, "kept", 7) for i, t in enumerate(TEXTS * 12)] + [(None, "no id", "kept", 7), (3, "<", "kept", 7), (3, "<", "kept", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, FORM int").repartition(3)
    made = fim.restore(fim.fill_in_middle(d, unit=unit))
    got = made.collect()
    assert made.columns == ["doc_id", "text", "source", "n_units", "form", "prefix_chars", "middle_chars", "fim_text", "restored"]
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == rule(r.text or "", draw_of(r.doc_id), unit)
        assert r.restored == (r.text or "")


def test_parameters(spark):
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    forms = lambda **k: {r.form for r in fim.fill_in_middle(d, **k).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=0) == {"psm"} and forms(rate=100, suffix_first=100) == {"spm"}
    own = ("[.", "|+", "$*")
    assert all(r.restored == r.text for r in fim.restore(fim.fill_in_middle(d, sentinels=own), sentinels=own).collect())
    a, b = (sorted(r.fim_text for r in fim.fill_in_middle(d, seed=s).collect()) for s in (1, 2))
    assert a != b
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P>", "<M>"), ("aba", "c", "d"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(d, sentinels=bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(d, unit="page")
    assert fim.restore(fim.fill_in_middle(d.where("false"))).collect() == []


def test_bytes_that_are_no_utf8(spark):
    d = spark.createDataFrame([(1, bytearray(b"a\xffb\xc3"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) text")
    r = fim.fill_in_middle(d, rate=100).selectExpr("n_units", "hex(replace(replace(replace(fim_text, '<P>', ''), '<S>', ''), '<M>', '')) h").first()
    assert r.n_units == 4 and sorted(re.findall("..", r.h)) == ["61", "62", "C3", "FF"]
