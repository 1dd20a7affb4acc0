import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from tramloom.llm import confusables
from tramloom.llm.lookalike import Tables, changed, form, groups, skeleton

CASES = {
    "ＷＩＫＡ　ｎăｍ": "WIKA năm", "a​b­c": "abc", "  x  \t y ": "x y", "КЕМ ĐÁNН": "KEM ĐÁNH", "НО А": "HO A", "МОЛОЧНЫЙ ПРОДУКТ 634 Г": "МОЛОЧНЫЙ ПРОДУКТ 634 Г", "ΜΕΛΙ ΤΟ ΘΥΜΑΡΙΟΥ": "ΜΕΛΙ ΤΟ ΘΥΜΑΡΙΟΥ", "ВОТ": "BOT",
    "tươnɡ ớt": "tương ớt", "FREESHIP ÐƠN ƉÁNH": "FREESHIP ĐƠN ĐÁNH", "乳製品": "乳製品", unicodedata.normalize("NFD", "녹차 음료"): "녹차 음료", "ΡΗΟ̂": "PHÔ", "a‑b “c”": 'a-b "c"', "CῸN SᾸ̃N": "CÒN SẴN",
    "ﬁsh": "fish", "cᎪfe": "cAfe", "ᏚALE": "SALE", "pⲟrk": "pork", "miⅼk": "milk", "ℎam": "ham", "ⒶB": "AB", "ꜱalt": "salt", "ᎪᏚ": "ᎪᏚ", "гора": "гора", "x² ™ ß ç": "x² ™ ß ç", "⭐ 1": "⭐ 1",
}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(confusables.prototypes(spark))


@pytest.mark.parametrize("text", CASES)
def test_form(tables, text):
    assert form(text, tables) == CASES[text]


@settings(max_examples=300, deadline=None)
@given(text=st.text())
def test_form_is_stable(tables, text):
    assert form(form(text, tables), tables) == form(text, tables)


@settings(max_examples=100, deadline=None)
@given(text=st.text("ạảấầđĐƯợ abcXYZ"))
def test_decomposed_is_the_same(tables, text):
    assert form(unicodedata.normalize("NFD", text), tables) == form(text, tables)


@settings(max_examples=200, deadline=None)
@given(text=st.text())
def test_form_looks_like_its_text(tables, text):
    assert skeleton(skeleton(text, tables), tables) == skeleton(text, tables)


def test_skeleton(tables):
    for a, b in (("corn", "ｃom"), ("l0", "IO"), ("pаte", "pate"), ("đ", "đ"), ("n\u0103m", "na\u0306m"), ("a\u200b  b", "a\u00a0b"), ("ﬁ", "fi")):
        assert skeleton(a, tables) == skeleton(b, tables)
    assert skeleton("pate", tables) != skeleton("pâte", tables)


def test_changed(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(100, None, ""), (101, "​ ", ""), (102, "", ""), (103, "x" * 300_000 + " ", "")]
    df = spark.createDataFrame(rows, "line_id long, text string, form string")
    got = {r.row_id: r.form for r in changed(df, "line_id", "text", "t").collect()}
    want = {str(i): f for i, (t, f) in enumerate(CASES.items()) if t != f}
    assert got == want | {"103": "x" * 300_000}
    assert changed(df.limit(0), "line_id", "text", "t").count() == 0


def test_groups(spark):
    df = spark.createDataFrame([("КЕМ",), ("KEM",), ("KEM",), ("a",), (None,), (" ",)], "text string")
    assert [tuple(r) for r in groups(df, "text").collect()] == [("KEM", 2, 3)]


def test_groups_over_all_tables(spark, tmp_path):
    from tramloom.llm.queries import FORM_FIELDS, p4_groups

    texts = {"ocr_lines": ["КЕМ", "n\u0103m", "na\u0306m"], "product_candidates": ["KEM", "a"], "gazetteer_entries": ["ＷＩＫＡ", "a"]}
    for name, _, column in FORM_FIELDS:
        spark.createDataFrame([(x,) for x in texts[name]], f"{column} string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(tuple(r) for r in p4_groups(spark, str(tmp_path)).collect()) == [("KEM", 2, 2), (unicodedata.normalize("NFD", "nărn"), 2, 2)]
