"""Small cases of the core operators against plain Python."""

import hashlib
import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramloom.functions import similarity, text as X
from tramloom.operators import candidates as C, gate as G, gazetteer as Z, images, linker as L, metrics as M, ocr_quality as Q, predict as P, router as R, rules as U, segments as S
from tramloom.sources import files, ocr
from tramloom.streaming.incremental import follow


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]


TEXTS = ["ĐỒ HỘP  Hạ Long!", "a​b", "x\r\ny \n\n\n\n z", "“q” – ’s", "☃ 10° A", "", "Ạ" * 3000, unicodedata.normalize("NFD", "Bánh mì"), "a_b c-d"]


def test_text_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    got = df.select("i", X.light(F.col("t")).alias("light"), X.key(F.col("t")).alias("key"), X.fold_key(F.col("t")).alias("fold"), X.tokens(X.light(F.col("t"))).alias("tokens")).orderBy("i").collect()
    assert [r.light for r in got] == ["ĐỒ HỘP Hạ Long!", "a b", "x\ny\n\nz", "\"q\" - 's", "10 A", "", "Ạ" * 3000, "Bánh mì", "a_b c-d", ""]
    assert [r.key for r in got] == ["đồ hộp hạ long", "a b", "x y z", "q s", "10 a", "", "ạ" * 3000, "bánh mì", "a_b c d", ""]
    assert got[0].fold == "do hop ha long" and got[7].fold == "banh mi" and got[8].tokens == ["a_b", "c-d"]
    again = df.select(X.key(F.col("t")).alias("k")).select("k", X.key(F.col("k")).alias("kk")).where("k <> kk").count()
    assert again == 0


def test_scalar_functions(spark):
    r = one(spark, X.safe_text(F.lit(" NaN ")), X.safe_bool(F.lit("Yes")), X.confidence(F.lit(87.0)), X.confidence(F.lit(-0.5)), X.parse_list(F.lit('["a", " ", "b"]')), X.parse_list(F.lit("a")), X.output_text(F.lit("a+b\n c")), X.shorten(F.lit("x" * 200)), X.entry_id(F.lit("k")))
    assert list(r) == ["", True, 0.87, -1.0, ["a", "b"], ["a"], "a + b c", "x" * 117 + "...", hashlib.sha1(b"entry:k").hexdigest()[:12]]
    c = one(spark, X.cer(F.lit("abc"), F.lit("abd")), X.cer(F.lit(""), F.lit("")), X.cer(F.lit("x"), F.lit(None).cast("string")), X.union_box(F.from_json(F.lit("[[1,2,3,4],[0,5,1,9]]"), "array<array<int>>")), X.box_of(F.from_json(F.lit("[[1,2],[5,9]]"), "array<array<int>>")))
    assert list(c) == [1 / 3, 0.0, 1.0, [0, 2, 4, 12], [1, 2, 4, 7]]


def test_segments_and_ngrams(spark):
    r = one(spark, S.split_segments(F.lit("a (b) / c + d + e; a")), S.ngrams(F.array(*map(F.lit, "xyz")), 1, 2), S.ngrams(F.array().cast("array<string>"), 1, 2), S.product_items(F.lit("a + b+c +  d")))
    assert len(r[0]) == 8 and set(r[0]) == {"a", "b", "c + d + e", "c", "d", "e", "c + d", "d + e"}
    assert [tuple(g) for g in r[1]] == [(0, 1, "x"), (1, 1, "y"), (2, 1, "z"), (0, 2, "x y"), (1, 2, "y z")] and r[2] == [] and r[3] == ["a", "b+c", "d"]
    lines = spark.createDataFrame([("d", 0, "a b"), ("d", 3, "c"), ("d", 4, "a b"), ("d", 5, "c")], "id string, line_index int, text string")
    got = {(x.line_index, x.text) for x in S.cross_line_ngrams(lines, ["id"]).collect()}
    assert got == {(0, "b c"), (0, "a b c"), (3, "c a"), (3, "c a b")}
    wide = spark.createDataFrame([("i", "x", None, " ")], "image_id string, raw_text string, hard_text string, soft_text string")
    assert [(x.variant, x.text) for x in S.unpivot_variants(wide, ["hard", "raw", "soft", "gone"], ["text", "conf"]).collect()] == [("raw", "x")]
    j = spark.createDataFrame([("a", '[{"text": "x", "conf": 0.5, "line_num": 4}, {"text": " "}]'), ("b", '{"lines": [{"text": "y"}]}'), ("c", "broken"), ("d", None)], "id string, j string")
    assert sorted((x.id, x.line_index, x.text) for x in S.json_lines(j, "id", "j").collect()) == [("a", 4, "x"), ("b", 0, "y")]


def test_dedupe_and_agreement(spark):
    rows = [("i", "k", 1, "a", 0.5), ("i", "k", 2, "b", 0.9), ("i", "k", 3, "b", 0.9), ("i", " ", 4, "a", 1.0), ("j", None, 5, "a", None), ("j", "k", 6, None, None)]
    df = spark.createDataFrame(rows, "image_id string, key string, seq int, variant string, conf double")
    assert sorted((r.image_id, r.seq) for r in C.dedupe(df, ["image_id"], "key", [F.coalesce("conf", F.lit(0.0))], "seq").collect()) == [("i", 2), ("j", 6)]
    got = {r.image_id: (r.support, r.available, r.agreement) for r in C.agreement(df, "image_id", "key", "variant").where("trim(key) <> ''").collect()}
    assert got == {"i": (2, 2, 1.0), "j": (0, 1, 0.0)}
    assert C.dedupe(df.limit(0), ["image_id"], "key", [F.col("conf")], "seq").count() == 0


def test_gazetteer(spark):
    labels = spark.createDataFrame([("Trà Sen",), ("TRÀ SEN",), ("Trà Sen",), ("Trà Sen + Bánh Mì",), (" ",), (None,)], "name string")
    e = {r.canonical_key: r for r in Z.entries(labels.fillna(""), "name").collect()}
    assert set(e) == {"trà sen", "bánh mì", "trà sen bánh mì"} and e["trà sen"].canonical_display == "Trà Sen" and e["trà sen"].frequency_prior == 4 and e["trà sen"].source_class == "mixed" and e["trà sen bánh mì"].item_count == 2
    f = spark.createDataFrame([(str(i), f"sen vang {w}") for i, w in enumerate("abcd")] + [("9", "x y")], "entry_id string, folded_key string")
    assert [tuple(r) for r in Z.shared_anchors(f).collect()] == [("sen vang", 4)] and Z.ambiguous_pairs(f).count() == 0
    assert [tuple(r) for r in Z.ambiguous_pairs(f, ratio=0.9).collect()] == [("sen", "vang", 4)]


def plain_ratio(a, b):
    return 100 * SequenceMatcher(None, a, b).ratio() if a.strip() and b.strip() else 0.0


def test_similarity():
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abđ🙂e") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 5)))
    a, b = [text() for _ in range(500)], [text() for _ in range(500)]
    a += ["", " ", "x", "kem", "a" * 250, "ab" * 150, "z" * 40_000, "kem"]
    b += ["a", "b", "x", "x kem y", "a" * 250, "ba" * 160, "z" * 30, "kem"]
    assert np.allclose(similarity.ratios(a, b), [plain_ratio(x, y) for x, y in zip(a, b)])

    def part(x, y):
        if len(x) == len(y):
            return plain_ratio(x, y)
        x, y = sorted((x, y), key=len)
        return max((plain_ratio(x, y[i : i + len(x)]) for i in range(len(y) - len(x) + 1)), default=0.0) if x.strip() else 0.0

    assert np.allclose(similarity.parts(a[:503], b[:503]), [part(x, y) for x, y in zip(a[:503], b[:503])])

    def sets(x, y):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            return 0.0
        c, p, q = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
        p, q = f"{c} {p}".strip(), f"{c} {q}".strip()
        return max(plain_ratio(c, p), plain_ratio(c, q), plain_ratio(p, q))

    assert np.allclose(similarity.word_sets(a, b), [sets(x, y) for x, y in zip(a, b)])
    best, kind = similarity.best_kinds(a[:503], b[:503], b[:503], a[:503])
    for i, (x, y) in enumerate(zip(a[:503], b[:503])):
        words = lambda t: " ".join(sorted(t.split()))
        all_ = [min(cap, f(p, q)) for (name, cap), f in zip(similarity.CAPS.items(), [sets, part, lambda p, q: plain_ratio(words(p), words(q)), plain_ratio] * 2) for p, q in ([(y, x)] if name.startswith("folded") else [(x, y)])]
        assert abs(best[i] - max(all_)) < 1e-9 and (kind[i] == all_.index(max(all_)) or not x or not y)
    few = [r.choice(a[:20]) for _ in range(800)]
    other = [r.choice(b[:200]) for _ in few]
    whole, kinds = similarity.best_kinds(few, other, few, other)
    for top in (1, 2, 5):
        part, part_kinds = similarity.best_kinds(few, other, few, other, top)
        for x in set(few):
            at = [i for i, y in enumerate(few) if y == x]
            first = sorted(at, key=lambda i: -whole[i])[:top]
            least = whole[first[-1]]
            assert all(part[i] == whole[i] and part_kinds[i] == kinds[i] if whole[i] >= least else part[i] < least for i in at)
    assert similarity.ratios([], []).tolist() == similarity.parts([], []).tolist() == []


def test_link(spark):
    e = spark.createDataFrame([("1", "Pate Gan", "pate gan", "pate gan", ["pate", "gan"], ["gan", "pate"], 5, ["Pa Tê"], ["pa te"]), ("2", "Bún Gạo", "bún gạo", "bun gao", ["bún", "gạo"], ["bun", "gao"], 3, None, None)], "entry_id string, canonical_display string, canonical_key string, folded_key string, token_keys array<string>, folded_token_keys array<string>, frequency_prior int, surface_variants array<string>, folded_surface_keys array<string>")
    c = spark.createDataFrame([(1, "PATE GAN"), (2, "bun gao"), (3, "pate gam ngon"), (4, "zzz"), (5, None), (6, "PATE GAN"), (7, "pa te")], "id int, clean_text string")
    got = {r.id: (r.matched, r.entry_id, r.match_type) for r in L.link(c, e).collect()}
    assert got[1] == got[6] == (True, "1", "exact") and got[2] == (True, "2", "folded_exact") and got[4] == got[5] == (False, None, "no_candidates") and got[7][:2] == (True, "1")
    assert got[3][0] is False or got[3][1] == "1"


def test_rules(spark):
    own = [("tea_green_mint", 100, 1.0, "Trà Xanh Bạc Hà", ["tra|xanh|bac ha"]), ("tea_green", 95, 0.9, "Trà Xanh", ["tra|xanh", "green tea"]), ("tea", 50, 0.5, "Trà", ["tra"])]
    t = spark.createDataFrame([(1, "TRÀ  xanh thơm Bạc-Hà"), (2, "Green tea"), (3, "xanh trà"), (4, "tranh"), (5, None), (6, "")], "id int, text string")
    found = U.hits(t, "id", "text", U.registry(spark, own))
    assert {(r.id, r.rule) for r in found.collect()} == {(1, "tea_green_mint"), (1, "tea_green"), (1, "tea"), (2, "tea_green"), (3, "tea")}
    assert {r.id: r.canonical for r in U.resolve(found, "id").collect()} == {1: "Trà Xanh Bạc Hà", 2: "Trà Xanh", 3: "Trà"}
    assert U.hits(t, "id", "text", U.registry(spark, [])).count() == 0
    words = ("xem them",)
    assert list(one(spark, U.rejected(F.lit("Xem Thêm"), words), U.rejected(F.lit("")), U.rejected(F.lit("kem"), words), U.rejected(F.lit("Xem Thêm")))) == [True, True, False, False]


EVIDENCE = "id string, entry_id string, gate_score double, match_score double, margin double, match_type string, is_strong boolean, specific boolean, first_line int, item_count int, words array<string>, prior int"


def test_gate(spark):
    strong = (100.0, 10.0, "exact", True, True)
    rows = [
        ("d", "1", 0.9, *strong, 0, 1, ["a", "b"], 5), ("d", "2", 0.88, *strong, 1, 1, ["c"], 5), ("d", "3", 0.8, *strong, 2, 1, ["a"], 5),  # two apart, one inside another
        ("f", "4", 0.9, *strong, None, 2, ["x"], 1), ("f", "5", 0.95, *strong, 0, 1, ["y"], 1),  # of several items
        ("g", "6", 0.9, 90.0, 4.0, "fuzzy_ratio", False, False, 0, 1, ["x"], 1),  # not qualified
        ("h", "7", 0.5, 89.0, 0.0, "fuzzy_partial", False, False, 0, 2, ["p", "q", "r"], 1), ("h", "8", 0.8, *strong, 0, 1, ["p"], 1), ("h", "9", 0.8, *strong, 1, 1, ["q"], 1),  # its parts speak for it
        ("i", "10", 0.5, 89.0, 0.0, "fuzzy_partial", False, False, 0, 2, ["p", "q", "r"], 1), ("i", "11", 0.8, *strong, 0, 1, ["p"], 1),  # one part doesn't
        ("j", "12", 0.85, 95.0, 9.0, "fuzzy_partial", True, False, 0, 1, ["m"], 1),
    ]
    e = spark.createDataFrame(rows, EVIDENCE)
    pool = spark.createDataFrame([("h", ["p", "q", "r"]), ("i", ["p", "q", "r"])], "id string, pool array<string>")
    chosen = G.choose(e, "id", pool)
    got = {r.id: (r["mode"], r.chosen, r.specific) for r in chosen.collect()}
    assert got == {"d": ("multi", ["1", "2"], True), "f": ("full", ["4"], True), "h": ("full", ["7"], False), "i": ("single", ["11"], True), "j": ("single", ["12"], False)}
    assert {r.entry_id for r in G.drop_subsets(e.where("id in ('d', 'f')"), "id", "words", ["gate_score", "match_score"]).collect()} == {"1", "2", "4", "5"}
    assert {r.id: r.n_close for r in G.ambiguous(e.where("id in ('d', 'f', 'g')"), "id", "words").collect()} == {"d": 1, "f": 1, "g": 0}
    docs = spark.createDataFrame([(x,) for x in "ddfghijklz"], "id string")
    rules = spark.createDataFrame([("k", "Rule", 95), ("l", "Weak", 80), ("j", "Weak", 94)], "id string, canonical string, priority int")

    def reasons(**more):
        return {r.id: (r.emit, r.reason) for r in G.decide(docs, chosen, rules, "id", **more).collect()}

    plain = {"d": (True, "multi"), "f": (True, "full"), "g": (False, "no_match"), "h": (True, "full"), "i": (True, "single"), "j": (True, "rule"), "k": (True, "rule"), "l": (False, "no_match"), "z": (False, "no_match")}
    assert reasons() == plain
    rules = rules.where("id <> 'j'")
    told = spark.createDataFrame([("d", 9), ("h", 3), ("j", 2)], "id string, negative int")
    assert reasons(contexts=told) == plain | {"h": (False, "negative_context"), "j": (False, "negative_context_low_margin")}
    topic = spark.createDataFrame([("j",), ("d",), ("k",)], "id string")
    assert reasons(generic=topic) == plain | {"j": (False, "generic_topic")}
    assert [(r.id, r.canonical) for r in G.rescued(docs, chosen, rules, "id").collect()] == [("k", "Rule")]
    assert G.choose(e.limit(0), "id", pool).count() == 0


def test_gate_score_and_context(spark):
    def score(agreement, available, positive=0, negative=0):
        c = [100.0, 12.0, 1.0, "line", 1.0, agreement, available, 1.0, 5, 5, "exact", positive, negative]
        return one(spark, G.gate_score(*[F.lit(x) for x in c]))[0]

    assert score(1.0, 1) == score(None, None) == 0.90 and score(1.0, 2) == 0.95 and score(0.5, 3) == 0.925
    assert score(0.0, 2, 3) == 0.95 and score(0.0, 2, 9) == 0.95 and score(0.0, 2, 0, 2) == 0.78 and score(0.0, 2, 0, 99) == 0.66
    t = spark.createDataFrame([("a", "Công  ty ABC"), ("a", "công ty, ngon"), ("b", None), ("c", "kem")], "id string, t string")
    assert {r.id: (r.negative, r.positive) for r in G.context(t, "id", ["t"], ["cong ty", "toa an"], ["ngon", "kem"]).collect()} == {"a": (1, 1), "b": (0, 0), "c": (0, 1)}
    yes = lambda *c: one(spark, G.specific(*[F.lit(x) for x in c[:4]], F.array(*[F.lit(x) for x in c[4]]), ["pate", "gan"]))[0]
    assert yes("exact", 0.0, 0, 0.0, ["x"]) and yes("fuzzy_ratio", 94.0, 2, 0.5, ["x"]) and yes("fuzzy_ratio", 88.0, 0, 0.0, ["pate", "gan"])
    assert not yes("fuzzy_ratio", 94.0, 1, 0.9, ["pate"]) and not yes("fuzzy_ratio", 87.0, 0, 0.0, ["pate", "gan"])


def test_leftovers_and_order(spark):
    rows = [("a", 1, True, 0.8, True, 99.0, 5.0), ("a", 2, False, None, False, 40.0, 1.0), ("a", 3, True, 0.9, False, 90.0, 9.0)]
    df = spark.createDataFrame(rows, "id string, seq int, matched boolean, gate_score double, is_strong boolean, score double, margin double")
    assert {r.seq: r.place for r in G.leftovers(df, "id").collect()} == {3: 1, 1: 2, 2: 3}


def test_final_names_and_metrics(spark):
    r = one(spark, P.final_names(F.array(*map(F.lit, ["Trà Sen", "trà sen", "Trà Sen + Bánh Mì", " ", "Kem"]))), P.final_names(F.array().cast("array<string>")))
    assert list(r) == ["Trà Sen + Bánh Mì + Kem", ""]
    rows = [("a", float(x)) for x in random.Random(1).sample(range(1000), 101)]
    (m,) = M.audit_summary(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert (m.n, m.median, m.p90) == (101, np.median([v for _, v in rows]), round(float(np.percentile([v for _, v in rows], 90)), 6))
    p, t = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "id string, n string"), spark.createDataFrame([("a", "x"), ("b", "z"), ("d", "w")], "id string, n string")
    assert tuple(M.f1(p, t, "id", "n").collect()[0]) == (1, 1, 2, 0.5, 0.333333, 0.4)
    assert M.validate(spark.createDataFrame([], "id string, n string"), "id", ["n"]).collect()[0].n_rows == 0


def test_quality_and_router(spark):
    rows = [("i", "hard_fallback", "", 0.1, 0), ("i", "raw_resized", "Kem đánh răng", 0.9, 3), ("i", "soft_enhanced", "Kem đánh răng!", 0.95, 3), ("j", "hard_fallback", "乳製品乳製品", 0.9, 2)]
    df = spark.createDataFrame(rows, "image_id string, variant string, text string, conf double, boxes int").withColumn("why", Q.reasons(F.lit(None).cast("string"), F.col("boxes"), F.col("text"), F.col("conf")))
    df = df.withColumn("score", Q.quality_score(F.col("boxes"), F.col("text"), F.col("conf"), F.col("why"), F.col("variant"))).withColumn("fatal", Q.is_fatal(F.col("why")))
    got = {r.image_id: (r.variant, r.reason) for r in Q.choose_variant(df, "image_id").collect()}
    assert got == {"i": ("raw_resized", "best_non_fatal"), "j": ("hard_fallback", "best_overall")}
    a = np.full((60, 80), 128.0)
    f = images.features(a)
    assert f["std_luma"] == 0 and f["noise"] == 0 and f["laplacian"] == 0
    pgm = b"P5\n80 60\n255\n" + a.astype(np.uint8).tobytes()
    out = {r.image_id: r for r in images.image_features(spark.createDataFrame([("ok", bytearray(pgm)), ("bad", bytearray(b"x"))], "image_id string, content binary")).collect()}
    assert out["ok"].mean_luma == 128 and out["ok"].width == 80 and out["bad"].error and out["bad"].width is None
    routed = R.route(spark.createDataFrame([(1.2, 128.0, 50.0, 150.0, 100.0, 0.1, 0.0, 0.0, 0.0)], "scale double, mean_luma double, std_luma double, luma_range double, laplacian double, edge_density double, noise double, background double, near_binary_ratio double")).collect()[0]
    assert (routed.reason, routed.primary_variant, routed.use_clahe) == ("small_image_upscale", "soft_enhanced", False)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    index = files.index_images(spark, str(tmp_path / "img"))
    assert sorted(r.stem for r in index.collect()) == ["a", "b"]
    assert files.densest_folder(index).collect()[0].n == 2
    ids = spark.createDataFrame([("a",), ("b.png",), ("z",)], "image_id string")
    assert {r.image_id: bool(r.path) for r in files.resolve_images(ids, index).collect()} == {"a": True, "b.png": True, "z": False}
    labels = spark.createDataFrame([("a", "x, \"y\"\nz", None), ("b", None, "p")], "image_id string, ocr_text string, product_name string")
    files.write_table(labels, str(tmp_path / "csv"), "image_id")
    got = {r.image_id: r for r in files.read_labels(spark, str(tmp_path / "csv")).collect()}
    assert got["a"].ocr_text == 'x, "y"\nz' and got["a"].product_name == "" and got["b"].ocr_text == ""
    assert [r.image_id for r in files.sample_labels(labels, 5).collect()] == ["a"]
    with pytest.raises(ValueError, match="lacks"):
        ids.write.option("header", True).csv(str(tmp_path / "bad"))
        files.read_labels(spark, str(tmp_path / "bad"))
    ocr.register("echo", lambda **_: lambda content: (content.decode(), 0.5, 1))
    out = {r.image_id: r for r in ocr.recognise(spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"\xff"))], "image_id string, content binary"), "echo").collect()}
    assert out["a"].text == "hi" and out["b"].error and out["b"].boxes == 0


def test_incremental(spark, tmp_path):
    src, to, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in ([("a", 1), ("b", 2), ("a", 1)], [("b", 3), ("c", 4)]):
        spark.createDataFrame(batch, "id string, n int").coalesce(1).write.mode("append").parquet(src)
        follow(spark, src, "id string, n int", to, "id", lambda df: df.where("n > 0"), check).awaitTermination(60)
    assert sorted((r.id, r.n) for r in spark.read.parquet(to).collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_retrieval_by_postings_and_by_joins_is_the_same(spark):
    from dataclasses import replace

    rows = [(str(i), n, n.lower(), n.lower().replace("à", "a"), sorted(n.lower().split()), sorted(n.lower().replace("à", "a").split()), f, v) for i, (n, f, v) in enumerate([("Trà Sen", 3, ["tra sem"]), ("Trà Xanh", 3, None), ("Trà Xanh Sen", None, []), ("Bún", 1, ["trà xanh", None, ""])])]
    e = spark.createDataFrame(rows, "entry_id string, canonical_display string, canonical_key string, folded_key string, token_keys array<string>, folded_token_keys array<string>, frequency_prior int, surface_variants array<string>").withColumn("folded_surface_keys", F.lit(None).cast("array<string>"))
    c = spark.createDataFrame([("Trà Xanh",), ("tra sem",), ("sen sen xanh",), ("khác",), (None,), ("",)], "clean_text string")
    p = L.phrases(c, "clean_text")
    for pool in (1, 2, 80):
        cfg = L.LinkConfig(pool=pool)
        got = sorted(tuple(r) for r in L.retrieve(p, e, cfg).collect())
        assert got == sorted(tuple(r) for r in L.retrieve(p, e, replace(cfg, most_sent=1)).collect()) and got
    assert {r.entry_id for r in L.retrieve(p, e, L.LinkConfig(pool=1)).where("key = 'trà xanh'").collect()} == {"1"}
    assert L.retrieve(p, e.limit(0)).count() == 0 and L.retrieve(p.limit(0), e).count() == 0


def test_settled_characters_are_composed_already():
    import re

    settled = re.compile("^[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), X.SETTLED) + "]$")
    r = random.Random(6)
    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000 and settled.match(chr(i))]
    assert len(chars) > 30_000 and "\u0301" not in chars and "ạ" in chars
    assert all(unicodedata.is_normalized("NFC", c) for c in chars)
    assert all(unicodedata.is_normalized("NFC", "".join(r.choices(chars, k=2000))) for _ in range(50))


def test_quantiles_and_summaries(spark):
    r = np.random.default_rng(7)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 500)) for v in r.integers(0, 40, n)] + [("d", None), (None, 3.0), ("e", 5.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.q0, x.q1) for x in M.quantiles(df, "g", "v", [0.5, 0.9]).collect()}
    want = {g: [v for k, v in rows if k == g and v is not None] for g in ("a", "b", "c", "e", None)}
    assert set(got) == set(want) and all(np.allclose(got[g], np.percentile(v, [50, 90])) for g, v in want.items())
    assert M.quantiles(df.limit(0), "g", "v", [0.5]).count() == 0
    s = {x.g: x for x in M.audit_summary(df, "g", "v").collect()}
    assert s["d"].n == 1 and s["d"].median is None and s[None].median == 3.0
    links = spark.createDataFrame([("i", True, True, 99.0, 5.0), ("i", False, False, 40.0, None)], "image_id string, matched boolean, is_strong boolean, score double, margin double")
    x = M.linking_summary(links).first()
    assert (x.n, x.n_ids, x.matched, x.matched_rate, x.strong, x.mean_score, x.median_score, x.mean_margin) == (2, 1, 1, 0.5, 1, 69.5, 69.5, 5.0)
    g = M.gating_summary(spark.createDataFrame([("i", True, 0.9), ("j", False, 0.1)], "image_id string, emit boolean, gate_score double")).first()
    assert (g.n, g.emitted, g.mean_gate_score) == (2, 1, 0.9) and M.linking_summary(links.limit(0)).first().n == 0
    board = M.objective(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 9.0), ("y", None)], "c string, v double"), "c", "v", F.col("v") > 8, 5.0, F.col("v").isNull()).orderBy("place").collect()
    assert [b.c for b in board] == ["x", "y"] and board[0].objective == round(1.5 + 0.5 * 1.9, 6) and board[1].objective == round(9 + 4.5 + 1 + 0.75 + 1.5, 6)


def test_audit(spark):
    readings = spark.createDataFrame([("a", "hard", "kem"), ("a", "soft", "kam"), ("b", "hard", None), ("z", "hard", "x")], "image_id string, variant string, text string")
    labels = spark.createDataFrame([("a", "KEM"), ("b", "x")], "image_id string, ocr_text string")
    got = {(r.image_id, r.variant): (r.cer, r.cer_lower, r.oracle) for r in M.audit_rows(readings, labels).collect()}
    assert got == {("a", "hard"): (1.0, 0.0, True), ("a", "soft"): (1.0, 0.333333, False), ("b", "hard"): (1.0, 1.0, True)}


def test_reading_order_and_lines(spark):
    df = spark.createDataFrame([("p", 1, [5, 10, 2, 2], "b", 0.9), ("p", 2, [0, 10, 2, 2], "a", 0.5), ("p", 3, [9, 0, 1, 1], "c", 0.1), ("p", 4, None, "d", 0.9), ("p", 5, [0, 0], " ", 0.9)], "page string, seq int, box array<int>, t string, conf double")
    assert {r.seq: r.line_num for r in S.reading_order(df, ["page"], "box", "seq").collect()} == {5: 0, 3: 1, 2: 2, 1: 3, 4: 4}
    (x,) = S.assemble_lines(df, ["page"], [], "seq", "t", "conf", 0.4, "box").collect()
    assert (x.text, x.n_words, x.box) == ("b a d", 3, [0, 10, 7, 2])


def test_small_pieces(spark, tmp_path):
    assert list(one(spark, X.odd(F.lit(4)), X.odd(F.lit(5)), X.odd(F.lit(0), 21))) == [5, 5, 21]
    assert P.text_column(spark.createDataFrame([(1, "x")], "id int, raw_text string")) == "raw_text"
    with pytest.raises(ValueError):
        P.text_column(spark.range(1))
    d = spark.createDataFrame([("a", True, "Kem"), ("b", False, "Kem"), ("c", True, None)], "id string, emit boolean, product_name string")
    assert {tuple(r) for r in P.product_frame(d, "id").collect()} == {("a", "Kem"), ("b", ""), ("c", "")}
    assert {r.id for r in P.wanted(d, spark.createDataFrame([("a",), ("a",), ("q",)], "id string"), "id").collect()} == {"a"}
    (tmp_path / "ids.csv").write_text("image_id,x\nb,1\na,2\nc,3\n")
    assert [r.image_id for r in files.read_ids(spark, [str(tmp_path / "none.csv"), str(tmp_path / "ids.csv")], 2).collect()] == ["b", "a"]
    with pytest.raises(FileNotFoundError):
        files.read_ids(spark, [str(tmp_path / "none.csv")])
    files.write_audit(d, spark.createDataFrame([(3, 0.5)], "n int, rate double"), str(tmp_path / "audit"), "id")
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "audit")).collect()] == ["a", "b", "c"] and spark.read.json(str(tmp_path / "audit.summary.json")).first().n == 3
    for _ in range(2):
        files.write_new_configs(spark.createDataFrame([("x", 1), ("y", 2)], "config string, v int"), str(tmp_path / "configs"))
    assert spark.read.parquet(str(tmp_path / "configs")).count() == 2
    assert C.as_json(d.where("id = 'a'"), "id").first().record == '{"id":"a","emit":true,"product_name":"Kem"}'
    keep = U.keep_candidate(F.col("c"), F.col("t"), ("xem",), {"cp": (["ngon"], ["cong ty"])})
    rows = [("CP", "CP ngon", True), ("CP", "công ty CP ngon", False), ("cp", "x", False), ("cp", " ", True), ("", "x", False), ("xem", "x", False), ("kem", "x", True), (None, "x", False)]
    assert [r.k for r in spark.createDataFrame([x[:2] for x in rows], "c string, t string").select(keep.alias("k")).collect()] == [x[2] for x in rows]


def test_gazetteer_build_save_load(spark, tmp_path):
    labels = spark.createDataFrame([("hộp patee gaan", "Pate Gan")] * 3 + [("nước mắm ngon ngon", "Nước Mắm + Pate Gan"), ("hạ giá hạ giá", None), ("", "Bún")], "ocr_text string, product_name string")
    alias = spark.createDataFrame([("gan xay", "PATE GAN"), ("x", "không có")], "alias string, canonical string")
    built = Z.build(labels, "ocr_text", "product_name", alias, spark.createDataFrame([("Freeship",), ("pate",), ("1",)], "token string"), least_df=1, most_ratio=0.5)
    e = {r.canonical_key: r for r in built["entries"].collect()}
    assert set(e) == {"pate gan", "nước mắm", "nước mắm pate gan", "bún"} and e["pate gan"].surface_variants == ["gan xay", "patee gaan"] and e["pate gan"].frequency_prior == 4
    Z.save(built, str(tmp_path / "g"))
    back = Z.load(spark, str(tmp_path / "g"))
    assert {k: df.count() for k, df in back.items()} == {k: df.count() for k, df in built.items()} and back["metadata"].first().n_entries == 4
    assert {r.token for r in back["fillers"].collect()} == {"hạ", "giá", "freeship"}
    assert {r.kind for r in back["index"].collect()} == set(L.KINDS)
