import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tramloom.llm.gazetteer import UNMATCHED, Listed, MatchConfig, core, decided, link_values, resolve, symbol_array, untelex

ENTRIES = [
    ("e1", "Kafagoxu Kem Đánh Răng Hương Bò Hầm", ["Kafagoxu Toothpaste Bò Hầm", "Toothpaste Bò Hầm Kafagoxu"]),
    ("e2", "Kafagoxu Kem Đánh Răng Hương Mè Đen", []),
    ("e3", "Benzinoha Muối Chấm Vị Atiso", ["Benzinoha Atiso"]),
    ("e4", "Benzinoha Snack Bắp Vị Bò Hầm", None),
    ("e5", "Ngàn Thương Muối Chấm Gà Nướng", ["Ngàn Thương Dip Salt Gà Nướng"]),
    ("e6", "Ngàn Thương Snack Bắp Hương Mè Đen", ["Ngàn Thương Bim Bim Bắp Mè Đen"]),
    ("e7", "Govila Farm Snack Bắp Hương Gà Nướng", []),
]
CASES = {
    "KAFAGOXU KEM DANH RANG HUONG BO HAM": "e1", "kem đánh răng bò hầm kafagoxu 500 g": "e1", "Xả kho Kafagoxu Toothpaste Bò Hầm (hộp 12 gói)": "e1", "KAFАGОXU KEМ ĐÁNH RĂNG НƯƠNG ΒÒ HẦΜ!": "e1",
    "Kafagoxv Kem Đanh Rang Huong Bo Hqm": "e1", "kafagoxu_kem_danh_rang_bo_ham": "e1", "KafagoxuKemDanhRangBoHam": "e1", "Kafa goxu Kem Danh Rang Bo Ham": "e1", "Kafagoxu Kafagoxu Kem Đánh Răng Bò Hầm": "e1", "Kafagoxu Kem Ddanhs Rawng Huwowng Bof Haamf": "e1",
    "Benzinoha Atiso": "e3", "Kafagoxu Kem Đánh Răng": UNMATCHED, "Kem Đánh Răng Bò Hầm": UNMATCHED, "Kafagoxu Bò Hầm": UNMATCHED, "Benzinoha Kem Đánh Răng Atiso": UNMATCHED, "Benzinoha Snack Bắp Atiso": UNMATCHED, "Ngàn Thương Muối Chấm Mè Đen": UNMATCHED,
    "Hàng có sẵn": UNMATCHED, "МОЛОЧНЫЙ ПРОДУКТ": UNMATCHED, "[NEW] Ngàn Thương Bim Bim Bắp Mè Đen 4x110ml": "e6", "GOVILA FARM SNACK BẮP GÀ NƯỚNG 1,5L": "e7", "x" * 500_000: UNMATCHED, "!!": UNMATCHED,
}


def index_of(entries):
    listed = Listed.of([(a, b, c or []) for a, b, c in entries])
    return listed.block([e for e, _, _ in entries])


def found(values, index, cfg=MatchConfig()):
    return [decided(a, b, cfg.margin) for a, b in zip(*resolve(pa.array(values), index, cfg))]


def test_cases():
    assert dict(zip(CASES, found(list(CASES), index_of(ENTRIES)))) == CASES


def test_parts():
    assert core("gia soc benzinoha atiso hop 12 goi") == "benzinohaatiso"
    assert untelex("bawps vij cay xes luwowix") == "bap vi cay xe luoi"
    index = index_of(ENTRIES)
    assert ("nganthuong", "snackbap", "meden") in index.parts and ("benzinoha", "", "atiso") in index.parts


@pytest.mark.parametrize("most", [1000, 4, 2, 1])
def test_any_number_of_blocks_gives_the_same(spark, most):
    e = spark.createDataFrame([*ENTRIES, ("e8", "Kafagoxu Kem Đánh Răng Hương Bò Hầm", None), ("e9", "Okafa Bún Gạo Vị Cay", None)], "entry_id string, canonical_display string, surface_variants array<string>")
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(1000, None, None), (1001, " \u200b", None), (1002, "Benzinoha Atiso", None), (1003, "Okafa Bún Gạo Cay", ""), (1003, "Okafa Bún Gạo Cay", "")]
    df = spark.createDataFrame(rows, "candidate_id long, clean_text string, entry_id string")
    out = link_values(df, e, cfg=MatchConfig(max_entries=most))
    got = {r.candidate_id: r.entry_id for r in out.collect()}
    # two entries of one name leave it unmatched, in whatever blocks they are
    want = {i: UNMATCHED if w == "e1" and "oothpaste" not in t else w for i, (t, w) in enumerate(CASES.items())}
    assert {i: got[i] for i in want if want[i] != UNMATCHED or CASES[list(CASES)[i]] == "e1"} == {i: w for i, w in want.items() if w != UNMATCHED or CASES[list(CASES)[i]] == "e1"}
    assert set(got) == {*range(len(CASES)), 1002, 1003} and got[1002] == "e3" and got[1003] == "e9" and out.count() == len(CASES) + 3


def test_long_parts_short_values_and_other_scripts():
    kind = "siêu thực phẩm dinh dưỡng hỗn hợp ngũ cốc nguyên hạt sấy khô cao cấp đặc sản vùng cao nguyên"
    entries = [("l1", f"Okafa {kind} Vị Mè", None), ("l2", f"Zunemi {kind} Vị Mè", None), ("s1", "ab", None), ("c1", "乳製品 緑茶 抹茶", None), ("c2", "乳製品 紅茶 抹茶", None)]
    index = index_of(entries)
    assert len(core(kind)) > 64 and index.peq.shape[0] > 1
    assert found([f"OKAFA {kind.upper()} ME", f"okafa {kind.replace('cốc', 'cóx')} mè", "AB", "ab!", "a", "abc", "乳製品 緑茶 抹茶", "乳製品 烏茶 抹茶"], index) == ["l1", "l1", "s1", "s1", UNMATCHED, UNMATCHED, "c1", UNMATCHED]


def test_edits_against_brute_force():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    names = [word(n) for n in (1, 5, 63, 64, 65, 100, 128, 129, 200)]
    index = index_of([(str(i), n, None) for i, n in enumerate(names)])

    def least(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            old, row = row, [0] * (len(p) + 1)
            for i, x in enumerate(p, 1):
                row[i] = min(old[i] + 1, row[i - 1] + 1, old[i - 1] + (x != c))
            best = min(best, row[-1])
        return best

    pairs = [(k, word(5) + "".join(c for c in n if r.random() > 0.1) + word(9)) for k, n in enumerate(index.names) for _ in range(6)]
    sizes = np.array([len(t) for _, t in pairs])
    got = index.edits(symbol_array("".join(t for _, t in pairs)), np.cumsum(sizes) - sizes, sizes, np.array([k for k, _ in pairs]))
    assert got.tolist() == [least(index.names[k], t) for k, t in pairs]


def test_accuracy_on_planted_cases(small):
    """Names of the list, misread, reordered and decorated, and names of which a part is missing or swapped."""
    rows = pq.read_table(f"{small}/gazetteer_entries.parquet", columns=["entry_id", "canonical_display", "surface_variants"]).to_pylist()
    index = index_of([(x["entry_id"], x["canonical_display"], [v for v in x["surface_variants"] or [] if v]) for x in rows])
    r = random.Random(3)
    parts = {e: p for e, p in zip([index.entry_ids[i] for i in index.entry], index.parts) if all(p)}
    listed, stated = set(parts.values()), {"".join(p) for p in index.parts}
    planted, wanted = [], []
    for entry, (b, k, v) in sorted(parts.items()):
        s = r.choice([b + k + v, k + v + b, b + k + "huong" + v])
        if r.random() < 0.5:
            i = r.randrange(len(s))
            s = s[:i] + r.choice("abcdeghiklmnopqrstuvxy") + s[i + r.randrange(2) :]
        planted.append(r.choice(["", "Giá sốc "]) + s + r.choice(["", " 500 g", " hộp 12 gói"]))
        wanted.append(entry)
        lacking = [x for x in (k + v, b + v, b + k) if x not in stated]
        planted += lacking
        wanted += [UNMATCHED] * len(lacking)
    for _ in range(300):
        (b, _, _), (_, k, v) = r.sample(sorted(listed), 2)
        if (b, k, v) not in listed:
            planted.append(b + k + v)
            wanted.append(UNMATCHED)
    got = found(planted, index)
    named = [g == w for g, w in zip(got, wanted) if w != UNMATCHED]
    wrong = [(p, g) for p, g, w in zip(planted, got, wanted) if g not in (UNMATCHED, w)]
    assert sum(named) >= 0.97 * len(named) and len(wrong) <= 0.03 * len(planted), (sum(named) / len(named), wrong[:9])


def test_empty(spark):
    e = spark.createDataFrame([], "entry_id string, canonical_display string, surface_variants array<string>")
    df = spark.createDataFrame([(1, "a b c")], "candidate_id long, clean_text string")
    assert [tuple(r) for r in link_values(df, e).collect()] == [(1, UNMATCHED)]
    assert link_values(df.limit(0), e).count() == 0
