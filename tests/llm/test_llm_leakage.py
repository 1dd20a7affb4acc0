import random
import re
import unicodedata

import pyarrow as pa
import pytest

from tramloom.llm.leakage import Items, LeakConfig, NearConfig, find_leaks, near, near_leaks


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", t.replace("đ", "d"))


def brute(docs, items, n=12):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = [(i, grams(t)) for i, t in items]
    texts = [(d, grams(t)) for d, t in docs]
    return {(d, i) for d, x in texts for i, g in held if g & x}


def made(seed):
    r = random.Random(seed)
    vocabulary = ["đồ", "hộp", "Hạ", "Long", "nước", "mắm", "kem", "2+1", "bún", "gạo", "trà", "xanh", "mè", "đen"]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(line(r.randint(5, 30)))) for i in range(12)] + [(90, None), (91, ""), (92, "x")]
    items.append((50, items[3][1]))
    docs = []
    for d in range(60):
        w = line(r.randint(0, 50))
        if d % 2:
            part = words(items[r.randrange(12)][1])
            a = r.randint(0, max(0, len(part) - 12))
            w[len(w) // 2 : len(w) // 2] = part[a : a + r.choice([11, 12, 13, 40])]
        sep = r.choice([" ", "  ", ", ", "\n", " - "])
        t = sep.join(w)
        docs.append((d, r.choice([t, t.upper(), unicodedata.normalize("NFD", t), t.replace("o", "o​")])))
    return docs + [(900, None), (901, ""), (902, " ".join(line(30_000)) + " " + (items[0][1] or ""))], items


@pytest.mark.parametrize("seed", range(4))
def test_exact_runs(spark, seed):
    docs, items = made(seed)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = find_leaks(d, e).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(docs, items)


def test_blocks_and_empty(spark):
    docs, items = made(9)
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in find_leaks(d, e, LeakConfig(max_items=3)).collect()} == brute(docs, items)
    assert find_leaks(d, e.limit(0)).count() == 0 and find_leaks(d.limit(0), e).count() == 0


def least_edits(item, text):
    """Fewest word edits between an item and any stretch of a text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        old, row = row, [0] * (len(item) + 1)
        for i, x in enumerate(item, 1):
            row[i] = min(old[i] + 1, row[i - 1] + 1, old[i - 1] + (x != c))
        best = min(best, row[-1])
    return best


def changed(r, w, edits):
    u = list(w)
    for _ in range(edits):
        i, kind = r.randrange(len(u)), r.randrange(3)
        u[i : i + (kind > 0)] = [] if kind == 1 else [f"new{r.randrange(99)}"]
    return u


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_recall_with_edits(edits):
    r = random.Random(edits)
    cfg = NearConfig()
    texts = [[f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(r.randint(15, 30))] for _ in range(300)]
    items = Items(list(range(300)), [" ".join(t) for t in texts], cfg)
    other = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    docs = [other(20) + changed(r, t, edits) + other(20) for t in texts]
    got = {(d, i): e for d, i, e in near(pa.array([" ".join(d) for d in docs]), items, cfg).tolist()}
    true = {i: least_edits(t, d) for i, (t, d) in enumerate(zip(texts, docs))}
    found = [(i, i) in got for i, e in true.items() if e <= 3]
    assert len(found) >= 290 and sum(found) >= (0.9 if edits > 1 else 0.95) * len(found), sum(found) / len(found)
    assert all(e == least_edits(texts[i], docs[d]) for (d, i), e in got.items())


def test_near_leaks(spark):
    r = random.Random(8)
    docs, items = made(3)
    item = dict(items)
    docs += [(2000 + k, " ".join(["zz"] * 5 + changed(r, words(item[i]), 1) + ["yy"] * 5)) for k, i in enumerate(i for i, t in items if len(words(t)) >= 10)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, edits int")
    e = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, i): n for a, t in docs if a != 902 for i, u in items if words(u) and (n := least_edits(words(u), words(t))) <= min(3, len(words(u)) // 5)}
    for cfg in (NearConfig(), NearConfig(max_items=4)):
        got = {(x.doc_id, x.item_id): x.edits for x in near_leaks(d, e, cfg).collect() if x.doc_id != 902}
        assert set(got) <= set(want) and all(got[k] == want[k] for k in got if want[k] == 0) and len(got) >= 0.9 * len(want) > 10
    assert near_leaks(d, e.limit(0)).count() == 0 and near_leaks(d.limit(0), e).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 14, 15, 17, 18, 100])
def test_window_sizes(n):
    assert n / 1.5 <= NearConfig().size(n) <= n
