import pytest

from tramloom.operators.packed import explode_values

CASES = [
    (None, []), ("", []), (" ​\t", []), ("nan", []), (" None ", []), ("NULL", []), ("[]", []),
    ("a, b;c\n\nd", ["a", "b", "c", "d"]), ('"a ""x"" b", c', ['a "x" b', "c"]), ("1. x\n2. y", ["x", "y"]),
    ('["a, b", null, "c\\u0041", "1,5L"]', ["a, b", "cA", "1,5L"]), ("['it\\'s', 'b, c']", ["it's", "b, c"]),
    ("a (x, y), b", ["a (x, y)", "b"]), ("Trà 1,5L, Sữa", ["Trà 1,5L", "Sữa"]), ("A/B x / C", ["A/B x", "C"]),
    ("x+ + y", ["x+", "y"]), ("x +y + +z", ["x", "y", "z"]), ('12" tv, 5" tv', ['12" tv', '5" tv']), ("- a\n* b", ["a", "b"]),
    ("“q, r” + «s; t»", ["q, r", "s; t"]), ('1) "a; b"\n2) c', ["a; b", "c"]), ("a ,, b ;", ["a", "b"]), ("5, 6", ["5", "6"]),
    ("0, b", ["0", "b"]), ('"a, b', ['"a', "b"]), ("a、b；c ＋ d", ["a", "b", "c", "d"]), ("a\r\na", ["a", "a"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "label_id long, product_name string")
    got = {}
    for r in explode_values(df, "product_name").orderBy("label_id", "item_pos").collect():
        got.setdefault(r.label_id, []).append((r.item_pos, r["item"]))
    for i, (text, items) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(items, 1)), text


def test_long_field_and_clashing_columns(spark):
    items = [f"name {i}" for i in range(20_000)]
    quoted = '"' + 'x ""y"" ' * 20_000 + '"'
    df = spark.createDataFrame([(1, "; ".join(items), "keep", 7), (2, quoted, None, None)], "label_id long, product_name string, item string, item_pos int")
    out = explode_values(df, "product_name")
    rows = {(r.label_id, r.item_pos): r["item"] for r in out.collect()}
    assert len(rows) == 20_001 and rows[(1, 20_000)] == "name 19999"
    assert rows[(2, 1)] == ('x "y" ' * 20_000).strip()


def test_empty_table(spark):
    assert explode_values(spark.createDataFrame([], "label_id long, product_name string"), "product_name").count() == 0


@pytest.mark.parametrize("delimiter", [", ", ";", "\n", "\t", " | ", " • ", " / ", " + ", "、", ";;"])
def test_round_trip(spark, delimiter):
    values = ["Đồ hộp 1,5L", 'kem "x"', "a/b", "c+ (d, e)"]
    packed = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    got = explode_values(spark.createDataFrame([(1, packed)], "i long, v string"), "v").orderBy("item_pos").collect()
    assert [r["item"] for r in got] == values
