import json

from tramloom.operators import nested
from tramloom.operators.nested import CHILDREN, child_keys, child_table

REPORT = {"is_bad": True, "score": 0.5, "reasons": ["a", None, "b"], "text_stats": {"text_length": 3, "alnum_ratio": 0.5}, "n_boxes": "2"}
RESULT = {"text": "x", "lines": [{"text": "x", "conf": "0.5", "box": [1, 2, 3, 4], "line_num": 0}, None, {"text": "y", "tokens": [{"text": "y"}]}]}
FULL = {"image_id": "i", "reports": {"hard": REPORT, "soft": None, "raw": {"reasons": None}}, "results": {"hard": RESULT, "raw": {"lines": None}, "soft": {}}}
LISTED = {"reports": [dict(REPORT, variant_name="hard"), None], "results": [dict(RESULT, variant_name="hard")]}
NAN = '{"reports": {"hard": {"score": NaN, "reasons": ["a"]}}, "results": {"hard": {"lines": [{"text": "x", "conf": Infinity}]}}}'


def rows(record):
    """The same by walking the parsed record."""
    try:
        x = json.loads(record)
        x = json.loads(x) if isinstance(x, str) else x
    except (TypeError, ValueError):
        return set()
    x = x.get("selection", x) if isinstance(x, dict) else {}
    pairs = lambda p: p.items() if isinstance(p, dict) else [(v["variant_name"], v) for v in p or [] if v]
    out = set()
    for v, r in pairs(x.get("reports")):
        if r is not None:
            out.add((v, "report", 0))
            out |= {(v, "text_stats", 0)} if r.get("text_stats") is not None else set()
            out |= {(v, "reason", i) for i, e in enumerate(r.get("reasons") or []) if e is not None}
    for v, r in pairs(x.get("results")):
        out |= {(v, "line", i) for i, e in enumerate((r or {}).get("lines") or []) if e is not None}
    return out


RECORDS = [json.dumps(FULL), json.dumps(LISTED), json.dumps(json.dumps(FULL)), json.dumps({"meta": {"v": 2}, "selection": FULL}, indent=1), json.dumps(json.dumps({"meta": {}, "selection": LISTED})), NAN, json.dumps(FULL)[:-40], json.dumps(FULL)[:90], "{}", "null", "", None, "[1]", '"x"', json.dumps({"reports": {}, "results": []})]


def test_child_keys(spark):
    df = spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(RECORDS)], "selection_id long, record_json string, child string, pos int")
    got = {}
    for r in child_keys(df).collect():
        got.setdefault(r.selection_id, []).append((r.variant_name, r.child, r.pos))
    for i, record in enumerate(RECORDS):
        assert sorted(got.get(i, [])) == sorted(rows(record)), (i, record)


def test_child_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(FULL)), (2, NAN)], "selection_id long, record_json string")
    line = {(r.selection_id, r.pos): r for r in child_table(df, "line").collect()}
    assert line[(1, 0)].conf == 0.5 and line[(1, 0)].box == [1, 2, 3, 4] and line[(1, 2)].text == "y"
    assert line[(2, 0)].conf == float("inf")
    report = {(r.selection_id, r.variant_name): r for r in child_table(df, "report").collect()}
    assert report[(1, "hard")].is_bad and report[(1, "hard")].n_boxes == 2 and report[(2, "hard")].score != report[(2, "hard")].score
    assert [r.reason for r in child_table(df, "reason").where("selection_id = 1").orderBy("pos").collect()] == ["a", "b"]
    assert child_table(df, "text_stats").collect()[0].text_length == 3


def test_empty(spark):
    df = spark.createDataFrame([], "selection_id long, record_json string")
    assert child_keys(df).count() == 0 and all(child_table(df, c).count() == 0 for c in CHILDREN)


def test_boxes_are_numbers_or_points(spark):
    from pyspark.sql import functions as F

    rows = ["[1, 2, 3, 4]", "[[5, 9], [1, 2], [7.9, 3]]", " [ [1, 2] ]", "[[1], null, [2, 3]]", "[]", "x", None, "[[]]"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b string").select("i", nested.typed(F.col("b"), "box").alias("b"))
    assert {r.i: r.b for r in df.collect()} == {0: [1, 2, 3, 4], 1: [1, 2, 6, 7], 2: [1, 2, 0, 0], 3: [2, 3, 0, 0], 4: [], 5: None, 6: None, 7: None}
