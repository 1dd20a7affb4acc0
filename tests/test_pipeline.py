import unicodedata

import numpy as np

from tramloom.operators import rules as U, surfaces as SV, variants as V
from tramloom.plans import pipeline as PL

ENTRIES = "entry_id string, canonical_display string, canonical_key string, folded_key string, token_keys array<string>, folded_token_keys array<string>, frequency_prior int, item_count int, surface_variants array<string>, folded_surface_keys array<string>"
LINES = "image_id string, variant string, line_index int, text string, conf double, box array<int>"


def entries(spark):
    def row(i, name, folded, n):
        return (i, name, name.lower(), folded, sorted(name.lower().split()), sorted(folded.split()), n, 1, None, None)

    return spark.createDataFrame([row("1", "Kem Đánh Răng Bò Hầm", "kem danh rang bo ham", 9), row("2", "Bún Gạo Mè Đen", "bun gao me den", 4), row("3", "Bún Gạo", "bun gao", 2)], ENTRIES)


def lines(spark):
    rows = [("a", "hard", 0, "KEM ĐÁNH RĂNG", 0.9, [0, 0, 9, 9]), ("a", "hard", 1, "BÒ HẦM", 0.9, None), ("a", "raw", 0, "Kem Đánh Răng Bò Hầm", 0.8, None), ("b", "hard", 0, "bun gao me den / giá 5", None, None), ("c", "hard", 0, "xin chào", 0.9, None), ("d", "hard", 0, None, None, None), ("e", "hard", 0, "Bánh ngọt Rồng Xanh", 0.9, None)]
    return spark.createDataFrame(rows, LINES)


def test_candidates(spark):
    got = {(r.image_id, r.normalized_key): r for r in PL.generate_candidates(lines(spark)).collect()}
    a = got[("a", "kem đánh răng bò hầm")]
    assert (a.support, a.available, a.agreement, a.source) == (2, 2, 1.0, "line")
    assert ("b", "bun gao me den") in got and ("a", "răng bò") in got and not [k for k in got if k[0] == "d"]
    fillers = spark.createDataFrame([("xin",)], "token string")
    assert ("c", "chào") in {(r.image_id, r.normalized_key) for r in PL.generate_candidates(lines(spark), fillers).collect()}
    assert PL.generate_candidates(lines(spark).limit(0)).count() == 0


def test_predict(spark):
    got = {r.image_id: (r.emit, r.reason, r.product_name) for r in PL.predict(lines(spark), entries(spark), U.registry(spark, [("dragon", 95, 1.0, "Bánh Rồng Xanh", ["banh|rong xanh"])])).collect()}
    assert got["a"] == (True, "single", "Kem Đánh Răng Bò Hầm") and got["b"] == (True, "single", "Bún Gạo Mè Đen")
    assert got["c"] == got["d"] == (False, "no_match", "") and got["e"] == (True, "rule", "Bánh Rồng Xanh")


def test_surface_mining(spark):
    labels = spark.createDataFrame([("ngon BUN GAO ME DEM 500 g", "Bún Gạo Mè Đen"), ("bún gạo mè đen", "Bún Gạo Mè Đen"), ("BUN GAO ME DEM", "Bún Gạo Mè Đen"), (None, "Bún Gạo Mè Đen"), ("khác", "Bún Gạo Mè Đen"), ("x", None)], "t string, n string")
    assert [tuple(r) for r in SV.mine(labels, entries(spark), "t", "n").collect()] == [("2", "BUN GAO ME DEM", 2)]
    # a variant that shares no word with the name
    e = spark.createDataFrame([("7", "pate gan")], "entry_id string, canonical_key string")
    labels = spark.createDataFrame([("hộp patee gaan mới", "Pate Gan"), ("hộp patee gaan mới", "Pate Gan"), ("nước mắm", "Pate Gan")], "t string, n string")
    assert [tuple(r) for r in SV.mine(labels, e, "t", "n").collect()] == [("7", "patee gaan", 2)]
    assert SV.mine(labels.limit(0), e, "t", "n").count() == 0


def test_variants(spark):
    a = np.full((40, 60), 200.0)
    a[10:20, 10:50] = 30
    assert 30 <= V.otsu(a) < 200 and set(np.unique(V.binarise(a, V.Binarise("x")))) == {0.0, 255.0}
    assert V.binarise(a, V.Binarise("x"))[15, 20] == 0 and V.binarise(255 - a, V.Binarise("x"))[15, 20] == 0
    assert V.resize(a, 2.0).shape == (80, 120) and V.resize(a, 1.01) is a
    assert len({c.name for c in V.configs()}) == len(V.configs()) == 19 and V.config_table(spark).count() == 19
    df = spark.createDataFrame([("ok", bytearray(V.encode(a)), 1.5), ("bad", bytearray(b"?"), None)], "image_id string, content binary, scale double")
    out = V.make_variants(df).collect()
    assert {r.variant for r in out if r.image_id == "ok"} == {"raw_resized", "soft_enhanced", "hard_fallback"} and [r.error for r in out if r.image_id == "bad"][0]
    assert V.make_variants(df.where("image_id = 'ok'"), V.configs()).count() == 19


def test_predict_scores_entries_beyond_the_closest(spark):
    # the misread word is no entry's, so all eight tie on the kind's words and the true one comes last by frequency
    names = ["Vàng Sao", "Bạc Lá", "Biển Xanh", "Đồi Mây", "Gió Núi", "Sông Quê", "Làng Tre"]
    rows = [(str(i), f"Mứt Trái Cây {n}", 50 - i) for i, n in enumerate(names)] + [("9", "Mứt Trái Cây Sunshinefarmvietnam", 1)]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).replace("đ", "d")
    e = spark.createDataFrame([(i, n, n.lower(), fold(n), sorted(n.lower().split()), sorted(fold(n).split()), f, 1, None, None) for i, n, f in rows], ENTRIES)
    read = spark.createDataFrame([("a", "hard", 0, "mứt trái cây sunshlnefarmvietnam", 0.9, None), ("a", "raw", 0, "mứt trái cây sunshlnefarmvietnam", 0.9, None)], LINES)
    assert [r.product_name for r in PL.predict(read, e).collect()] == ["Mứt Trái Cây Sunshinefarmvietnam"]


def test_queries_strip_mined_fillers(spark, tmp_path):
    from tramloom.plans import queries

    # "giảm" is a filler; "BUN" and "sen" belong to names; "chung" is as common where there are products
    labels = [("giảm BUN sen chung", None)] * 9 + [("bún gạo chung", "Bún Gạo")] * 20 + [("", "Bún Gạo")] * 2
    spark.createDataFrame(labels, "ocr_text string, product_name string").write.parquet(f"{tmp_path}/train_labels.parquet")
    entries(spark).write.parquet(f"{tmp_path}/gazetteer_entries.parquet")
    rows = [("f", "hard", 0, "Giảm Bún Gạo Mè Đen"), ("g", "hard", 0, "giảm bún gạo / giảm mè đen"), ("g", "raw", 0, "GIẢM"), ("h", "hard", 0, "bún gạo"), ("h", "hard", 1, "giảm"), ("h", "hard", 2, "mè đen")]
    spark.createDataFrame([(*r, 0.9, None) for r in rows], "image_id string, variant_name string, line_index int, text string, conf double, box array<int>").write.parquet(f"{tmp_path}/ocr_lines.parquet")
    assert [r.token for r in queries._fillers(spark, str(tmp_path)).collect()] == ["giảm"]
    got = {(r.image_id, r.normalized_key): r for r in queries.generated_candidates(spark, str(tmp_path)).collect()}
    assert not [k for k in got if "giảm" in k[1]] and ("f", "bún gạo mè đen") in got and ("h", "gạo mè") in got
    assert got["g", "bún gạo"].source == got["g", "mè đen"].source == "segment" and got["g", "bún gạo"].available == 2
    assert {r.image_id: r.product_name for r in queries.predicted_names(spark, str(tmp_path)).collect()}["f"] == "Bún Gạo Mè Đen"
