"""What links hold and send: nothing that grows with the candidates travels to all tasks, however small their files look."""

import pytest

from tramloom.functions import similarity, text as X
from tramloom.operators import linker as L
from tramloom.plans import queries as core


def sent_tables(df, aggregated=True):
    """Columns of the files scanned below a broadcast, in the plan as it starts; with or without those that are first aggregated."""
    found = []

    def walk(node, below):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan(), below)
        if below and name.startswith("Scan"):
            found.append(node.output().toString())
        if below and name.startswith("MapInArrow"):
            found.append(name)
        for i in range(node.children().size()):
            walk(node.children().apply(i), (below or name.startswith("BroadcastExchange")) and (aggregated or "Aggregate" not in name))

    walk(df._jdf.queryExecution().executedPlan(), False)
    return found


EXACT = ["entry_qualify", "gate_decision", "rescue_anti_join", "submission", "token_pool", "validate_submission", "entry_evidence", "full_vs_compose", "gate_score", "subset_dedupe"]


@pytest.mark.parametrize("name", EXACT)
def test_exact_links_build_no_pool(spark, small, monkeypatch, name):
    def none(*args, **kwargs):
        raise AssertionError("a pool was built")

    monkeypatch.setattr(L, "retrieve", none)
    df = core.QUERIES[name](spark, small)
    # rows an image may travel, rows a candidate may not
    assert not [x for x in sent_tables(df) if "clean_text" in x or "normalized_key" in x or x == "MapInArrow"] and df.count() > 0


def test_exact_links_by_broadcast_and_by_shuffle(spark, small):
    c, e = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("product_candidates", "gazetteer_entries"))
    c = c.select("candidate_id", "clean_text")
    got, want = ([tuple(map(str, r)) for r in L.link(c, e, cfg=L.LinkConfig(fuzzy=False, most_rows=n)).orderBy("candidate_id").collect()] for n in (0, 50_000))
    assert got == want and len(got) == c.count() and any("surface_folded" in r for r in got)


def test_plain_texts_have_the_key_of_the_long_way(spark):
    texts = ["", " ", "a", "Bún Gạo", "BÚN  GẠO", " x", "x ", "x\n", "x\ny", "ĐÈN 5g", "a_b", "İstanbul", "ŒUVRE ǅ", "é", "é", "a-b", "ﬁ", None, "ỳ Ỹ", "a b", "ɏ ɐ", "ß ẞ", "ª º", "²"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert not [r for r in df.select("t", X.key(df.t).alias("a"), X.key_of_light(X.light(df.t)).alias("b")).collect() if r.a != r.b]


def test_matches_where_the_phrases_are_equal_those_by_joins(spark, small):
    c, e = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("product_candidates", "gazetteer_entries"))
    p = L.phrases(c, "clean_text").where("crc32(key) % 4 = 0")
    for top in (1, 5):
        got, want = (sorted(map(str, L.matches(p, e, L.LinkConfig(top=top, most_scored=n)).collect())) for n in (5_000, 0))
        assert got == want and len(got) > 100


def test_top_scores(spark):
    import random

    import numpy as np

    rng = random.Random(7)
    words = ["bún", "gạo", "mè", "đen", "kem", "răng", "x", "", "trà", "sữa chua", "sen" * 30]
    text = lambda n: " ".join(" ".join(rng.choice(words) + rng.choice(["", "", "z", "q"]) for _ in range(rng.randrange(n))).split())
    fold = lambda t: t.replace("đ", "d").replace("ú", "u").replace("ạ", "a")
    a, b = [text(6) for _ in range(60)], [text(7) for _ in range(40)]
    fa, fb = [fold(t) for t in a], [fold(t) for t in b]
    phrase, entry = np.repeat(np.arange(60), 40), np.tile(np.arange(40), 60)
    best, kind = similarity.best_kinds([a[i] for i in phrase], [b[i] for i in entry], [fa[i] for i in phrase], [fb[i] for i in entry])
    one = np.array([len(x.split()) == 1 for x in a])[phrase]
    none = np.array([not a[i] or not b[j] for i, j in zip(phrase, entry)])
    want = np.round(np.where(none, 0, np.where(one, np.minimum(best, similarity.SINGLE_TOKEN_CAP), best)), 4)
    for top in (1, 5, 40):
        got, k = similarity.Names(b, fb).top_scores(a, fa, phrase, entry, np.full(len(phrase), -1.0), top)
        last = np.sort(want.reshape(60, 40), 1)[:, -top][phrase]
        first = want >= last
        assert (got[first] == want[first]).all() and (got[~first] < last[~first]).all()
        assert (k[first & ~none] == kind[first & ~none]).all()


@pytest.mark.parametrize("name", ["link_best", "linking_summary", "links_in_order"])
def test_fuzzy_links_build_no_pairs(spark, small, monkeypatch, name):
    def none(*args, **kwargs):
        raise AssertionError("pairs were built")

    monkeypatch.setattr(L, "retrieve", none)
    assert not [x for x in sent_tables(core.QUERIES[name](spark, small), aggregated=False) if "clean_text" in x or x == "MapInArrow"]


def test_only_matched(spark, small):
    c, e = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("product_candidates", "gazetteer_entries"))
    p = L.phrases(c, "clean_text").where("crc32(key) % 2 = 0")
    for top in (2, 5):
        got = sorted(map(str, L.matches(p, e, L.LinkConfig(top=top, only_matched=True)).collect()))
        assert got == sorted(map(str, L.matches(p, e, L.LinkConfig(top=top)).where("matched").collect())) and len(got) > 100
