import random

import pytest

from tramloom.llm import mixing
from tramloom.llm.tokens import _encoding, count_tokens, default_vocabulary, with_tokens

MIX = [("a", 0.5, 1), ("B ", 0.3, 4), ("c-c", 0.4, 2), ("gone", 0.2, 1), (None, 0.5, 1)]


def tokens(spark, sizes):
    rows = [(f"{s}{i}", s, 10 + i * 7 % 23) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, tokens long"), rows


def mix(spark, rows=MIX):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares(spark):
    t, _ = tokens(spark, {"a": 4000, " b": 90, "C_c": 700, "other": 50})
    got = {r.source: r for r in mixing.shares(t, mix(spark)).collect()}
    assert set(got) == {"a", "b", "c_c", "gone"} and got["gone"].actual_share == 0 and got["b"].most_repeats == 4
    for s, w in (("a", 0.5), ("b", 0.3), ("c_c", 0.4)):
        assert abs(got[s].actual_share - w / 1.2) < 0.01 and got[s].share == round(w / 1.2, 6)


@pytest.mark.parametrize("total", [None, 2000, 10**7])
def test_repeats_keep_to_their_caps(spark, total):
    t, rows = tokens(spark, {"a": 300, "b": 20, "c c": 100})
    planned = mixing.plan(t, mix(spark), total, 64)
    used = mixing.repeats(t, planned, 64).collect()
    caps = {"a": 1, "b": 4, "c_c": 2}
    assert all(0 <= r.repeats <= caps[r.source] for r in used) and len(used) == 420
    p = {r.source: r for r in planned.collect()}
    for s in caps:
        got = sum(r.repeats * r.tokens for r in used if r.source == s)
        assert min(p[s].blocks * 64, p[s].tokens * p[s].max_repeats) <= got < p[s].blocks * 64 + 40
        at = sorted((r["at"], r.tokens) for r in used if r.source == s)
        assert all(x + n == y for (x, n), (y, _) in zip(at, at[1:])) and at[0][0] == 0


def test_points_are_counted_without_drawing_them():
    drawn = [i * mixing.GOLDEN % mixing.RING for i in range(2000)]
    r = random.Random(1)
    for _ in range(200):
        n, (a, b) = r.randint(0, 2000), sorted((r.randint(0, mixing.RING), r.randint(0, mixing.RING)))
        assert mixing.points_on(n, a, b) == sum(a <= x < b for x in drawn[:n])


def check_schedule(spark, t, m, total, block):
    """Every use that the plan counts is placed whole, every slot has a row, blocks are equal."""
    planned = {r.source: r for r in mixing.plan(t, m, total, block).collect()}
    sizes = {r.doc_id: r.tokens for r in t.collect()}
    used = {(r.doc_id, k) for r in mixing.repeats(t, mixing.plan(t, m, total, block), block).collect() for k in range(r.repeats)}
    rows = mixing.schedule(t, m, total, block).collect()
    slots = next(iter(planned.values())).slots
    assert {r.slot for r in rows} == set(range(slots))
    placed, held = {}, {}
    for r in rows:
        assert (r.doc_id is None) == (r.block is None)
        if r.doc_id is not None:
            placed[r.doc_id, r["round"]] = placed.get((r.doc_id, r["round"]), 0) + r.stop_token - r.first_token
            held[r.slot] = held.get(r.slot, 0) + r.stop_token - r.first_token
    assert set(placed) == used and all(n == sizes[d] for (d, _), n in placed.items())
    of = {r.slot: (r.source, r.block) for r in rows}
    for s, p in planned.items():
        mine = {b for x, b in of.values() if x == s and b is not None}
        assert mine == set(range(p.blocks))
    assert all(n == block for slot, n in held.items() if of[slot][1] < planned[of[slot][0]].blocks - 1)
    return planned, of


def test_schedule(spark):
    t, _ = tokens(spark, {"a": 500, "b": 40, "c_c": 200})
    _, of = check_schedule(spark, t, mix(spark), None, 64)
    half = sorted(of)[: len(of) // 2]
    assert abs(sum(of[s][0] == "a" for s in half) / len(half) - 0.5 / 1.2) < 0.06
    whole = mixing.slot_table(mixing.plan(t, mix(spark), None, 64)).collect()
    assert sorted(mixing.slot_table(mixing.plan(t, mix(spark), None, 64), chunk=7).collect()) == sorted(whole)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_schedule_of_many_small_sources(spark, seed):
    r = random.Random(seed)
    t, _ = tokens(spark, {f"s{i}": r.randint(1, 12) for i in range(30)})
    m = mix(spark, [(f"s{i}", r.uniform(0.01, 1), r.randint(1, 5)) for i in range(30)])
    check_schedule(spark, t, m, None, 16)
    check_schedule(spark, t, m, 20_000, 16)


def test_long_document_fills_slots_of_its_own(spark):
    t = spark.createDataFrame([("x", "a", 1000), ("y", "a", 3), ("z", "b", 700)], "doc_id string, source string, tokens long")
    check_schedule(spark, t, mix(spark, [("a", 0.5, 2), ("b", 0.5, 3)]), None, 10)


def test_nulls_and_empty(spark):
    t = spark.createDataFrame([("d", None, 5), ("e", "a", None), ("f", "a", 0)], "doc_id string, source string, tokens long")
    assert mixing.shares(t, mix(spark)).where("used_tokens > 0").count() == 0
    assert mixing.schedule(t.limit(0), mix(spark)).count() == 0 and mixing.shares(t, mix(spark).limit(0)).count() == 0


def test_tokens(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "a", "Đồ hộp Hạ Long"), (2, "a", None), (3, None, "")], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in with_tokens(df).collect()}
    enc = _encoding(default_vocabulary())
    assert got == {1: len(enc.encode_ordinary("Đồ hộp Hạ Long")), 2: 0, 3: 0}
    long_ = "Đồ hộp  Hạ Long, 12 hộp.\n" * 3000
    assert count_tokens(long_, enc) == len(enc.encode_ordinary(long_))


@pytest.mark.parametrize("total, block", [(24000, 8), (10**6, 64), (700, 64)])
def test_schedule_of_a_given_total_places_every_copy(spark, total, block):
    t, _ = tokens(spark, {"a": 500, "b": 40, "c_c": 200})
    check_schedule(spark, t, mix(spark), total, block)
