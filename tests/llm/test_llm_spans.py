import random

import numpy as np
import pytest

from tramloom.llm.spans import least_positions, shared_spans


def brute(docs, span):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        marked = set()
        for i in range(len(t or "") - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                marked |= set(range(i, i + span))
        if marked:
            out[d] = len(marked)
    return out


def intervals(docs, span):
    """(doc_id, start, stop) of the runs of windows that stand in another document too."""
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in docs:
        at = [i for i in range(len(t or "") - span + 1) if len(seen[t[i : i + span]]) > 1]
        first = [i for k, i in enumerate(at) if not k or i >= at[k - 1] + span]
        out |= {(d, i, max(j for j in at if j < n) + span) for i, n in zip(first, [*first[1:], 1 << 40])}
    return out


def made(seed, span):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeđệ🙂 \n") for _ in range(n))
    pool = [text(r.randint(span // 2, 3 * span)) for _ in range(6)]
    docs = [(i, text(r.randint(0, 2 * span)) + r.choice(pool) + text(r.randint(0, 30)) + r.choice(pool)[r.randint(0, 9) :]) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, docs[0][1]), (103, docs[0][1]), (104, "z" * 4 * span), (105, docs[1][1] + "!"), (106, text(span - 1)), (107, text(100_000) + pool[0])]


@pytest.mark.parametrize(("seed", "span", "most_sent"), [(1, 20, 0), (2, 40, 1000), (3, 200, 1000), (4, 12, 1000)])
def test_against_brute_force(spark, seed, span, most_sent):
    docs = made(seed, span)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")
    out = shared_spans(df, span, span // 2, most_sent).collect()
    copies = {i for i, t in docs if sum(t == x for _, x in docs) > 1}
    assert {(r.doc_id, s.start, s.stop) for r in out for s in r.spans if r.doc_id not in copies} == {x for x in intervals(docs, span) if x[0] not in copies}
    assert {r.doc_id: r.shared_chars for r in out} == brute(docs, span) and len(out) == len({r.doc_id for r in out})
    for r in out:
        assert all(a.stop <= b.start for a, b in zip(r.spans, r.spans[1:])) and all(s.stop - s.start >= span for s in r.spans)


def test_window_of_a_partly_shared_stretch_whose_partner_is_wholly_shared(spark):
    # c shares windows with a and b only at the end of a stretch that a and b share as a whole
    r = random.Random(9)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core = part(230)
    docs = [(1, part(80) + core + part(9)), (2, part(60) + core + part(30)), *[(10 + k, part(50) + core[k : k + 205] + part(50)) for k in range(0, 25, 3)], (50, core[:203] + core[20:226])]
    got = {x.doc_id: x.shared_chars for x in shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 200)


def test_hot_text(spark):
    hot = "".join(chr(97 + i % 23) for i in range(300))
    docs = [(i, hot if i % 3 else f"{i} " + hot + f" {i * 7}") for i in range(300)]
    got = {r.doc_id: r.shared_chars for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 200)


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("width", [1, 2, 7, 8, 101])
def test_least_positions(width):
    h = np.random.default_rng(width).integers(0, 1 << 63, 500, dtype=np.uint64)
    got = least_positions(h, width)
    assert got.tolist() == [i + int(h[i : i + width].argmin()) for i in range(500 - width + 1)]
