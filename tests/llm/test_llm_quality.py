import unicodedata

import numpy as np

import pyarrow as pa

from tramloom.llm.lines import Lines
from tramloom.llm.quality import KINDS, QualityConfig, fit, hashes_of, kinds, model_of, seed_model, statistics, viterbi

COMMON = ["và", "là", "của", "có", "cho", "thì", "the", "and", "is", "with", "was", "for", "nên", "khi", "với", "mà", "này"]
PROSE = "Nước mắm này có vị mặn và thơm, nên cả nhà dùng với cơm nóng.\nKhi trời lạnh thì bún là món của mẹ."
TEXTS = {
    "prose": [PROSE, "The soup was warm and the label is clean for a jar with lid.", PROSE.upper(), "Nuoc mam nay co vi man va thom, nen ca nha dung voi com nong.", PROSE + "\n- một\n- hai", " ".join([PROSE.replace("\n", " "), "The soup is warm and grandma was here with the jar."] * 60), unicodedata.normalize("NFD", PROSE)],
    "list": ["- kem đánh răng\n- bột giặt\n- nước xả", "Nguyên liệu:\nbột năng\nkem đánh răng\nnước cốt\n12 hộp bún gạo", "bột năng; kem; nước cốt (3%); bún; gạo lứt; mè đen", "#kem #bun #gao #traxanh", "1. Kem Đánh Răng\n2. Bột Giặt"],
    "table": ["Mã\tGiá\tTồn\nK1\t10.000\t3\nK2\t\t4", "| a | b |\n|---|---|\n| 1 | 2 |", "Lô;Giá;Hạn\nL1;10.000;3/4/27\nL2;;5/6/27", "Mã    Giá    Tồn\nK1    10     3\nK2    11     4", "Natri,243.0 mg,7%\nKali,87,5 g,83%\nTro,1 g,3%"],
    "junk": ["ok ok ok ok ok ok ok ok ok ok ok", "zxvbn qwrtp klmnb vcxzq trplk", "0UfX9aQzPTLc3pHlIEzufxfVYo2M8QvW7jqcfKoo0gqu2CY46", "<¬ ơ[a^% i I= al|¬ ê» <[oe+o¬+o§", "7222 54429570 3997562409989 8466", "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-", "the qwrtz of bcdfgk xkcd the pqrst vbnm", "có zxcvb là qwrtp và mnbvc plkjh có bcdfg", "Loáº¡i bÃ¡nh trÃ¡ng nÃ y cÃ³ chai thá»§y tinh táº¡m"],
}


def test_kinds(spark):
    rows = [(f"{k}{i}", t, 1.0) for k, ts in TEXTS.items() for i, t in enumerate(ts)] + [("null", None, 0.0), ("blank", " \n​", 0.0), ("long", PROSE * 3000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, prose double")
    got = {r.doc_id: r for r in kinds(df, spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")).collect()}
    assert {k: r.kind for k, r in got.items()} == {f"{k}{i}": k for k, ts in TEXTS.items() for i in range(len(ts))} | {"long": "prose"}
    assert all(abs(r.prose + r["list"] + r["table"] + r.junk - 1) < 1e-9 for r in got.values())
    assert kinds(df.limit(0), spark.createDataFrame([], "word string")).count() == 0


def test_viterbi_against_brute_force():
    from itertools import product

    cfg = QualityConfig()
    draw = np.random.default_rng(3)
    lengths = [0, 1, 5, 3, 0, 4, 1]
    scores = draw.normal(0, 2, (sum(lengths), 4))
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = viterbi(scores, first, seed_model(cfg).move)
    for a, b in zip(first, first[1:]):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) + sum(np.log(cfg.stay if x == y else (1 - cfg.stay) / 3) for x, y in zip(p, p[1:]))  # noqa: E731, B023
        assert b == a or tuple(got[a:b]) == max(product(range(4), repeat=int(b - a)), key=value)
    assert len(KINDS) == 4


def test_statistics(spark):
    df = spark.createDataFrame([(1, "ab cd.\n☃ 12"), (2, None), (3, " ")], "doc_id long, text string")
    (r,) = statistics(df, spark.createDataFrame([("CD",), ("và",), (None,)], "word string")).collect()
    assert r.common_ratio == round(1 / 3, 6)
    assert (r.n_chars, r.n_words, r.mean_word_length, r.n_lines, r.punctuated_lines) == (11, 3, 2.0, 2, 0.5)
    assert r.symbol_ratio == round(1 / 11, 6)


def brute_line(line):
    """A line's statistics, one character after another."""
    words = "".join(c if c.isalnum() else " " for c in line).split()
    tokens = line.split()
    dense = "".join(tokens)
    return len(words), sum(map(len, words)) / max(1, len(words)), len(tokens), len(dense), round(1 - sum(c.isalnum() for c in dense) / len(dense), 9), line.rstrip()[-1] in ".!?…:;", line.rstrip()[-1] == ":"


def test_lines_against_brute_force():
    rng = np.random.default_rng(5)
    alphabet = list("abeđÀ19 .,;:|/#-\t\n\r☃文") + ["  ", "http", "\u200b", "é", "<br/>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 90))) for _ in range(400)] + [None, "", "\n \n", "x", "a" * 5000, "tail\n"]
    x = Lines(pa.array(texts, pa.string()), *hashes_of(["a", "be"]))
    want = []
    for i, t in enumerate(texts):
        t = (t or "").replace("\u200b", "").replace("<br/>", "\n")
        want += [(i, *brute_line(r)) for r in t.replace("\r", "\n").split("\n") if r.strip()]
    got = list(zip(x.doc.tolist(), x.words.tolist(), x.word_length.tolist(), x.tokens.tolist(), x.dense.tolist(), np.round(x.symbols, 9).tolist(), x.ended.tolist(), x.heading.tolist()))
    assert got == want


def test_lines_of_empty_batches():
    for texts in ([], [None], ["", " "]):
        assert Lines(pa.array(texts, pa.string()), *hashes_of([])).n == 0


def test_fit_reads_a_bounded_sample_and_needs_none(spark):
    cfg = QualityConfig(fit_docs=50)
    df = spark.createDataFrame([(i, f"{PROSE} {i}") for i in range(2000)], "doc_id long, text string")
    m = fit(df, hashes_of(COMMON), cfg)
    assert np.allclose(np.exp(m.move).sum(1), 1) and all(np.abs(v).max() <= cfg.most for v in m.odds.values())
    assert np.allclose(np.exp(fit(df.limit(0), hashes_of(COMMON), cfg).move), np.exp(seed_model(cfg).move))


def test_fit_counts_the_lines_of_all_documents(spark):
    cfg = QualityConfig()
    rows = [(i, f"{PROSE} {i}") for i in range(3000)] + [(i, f"- một\n- hai\n- {i}") for i in range(400)] + [(0, f"{PROSE} again")] * 50 + [(1, None), (2, " \n"), (3, "")]
    moves = np.zeros((4, 4))
    moves[0, 0], moves[1, 1] = 3000 + 50, 2 * 400  # of lines that the seed model calls prose and list
    for parts in (1, 7):
        m = fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), hashes_of(COMMON))
        assert np.allclose(m.move, model_of(moves.ravel(), {}, cfg).move, rtol=0, atol=1e-12)


def test_kinds_label_by_a_model_of_all_documents(spark):
    """The lines of the one long document change the label of another."""
    words = spark.createDataFrame([(w,) for w in COMMON], "word string")
    rows = [("long", "- một hai ba bốn\n" * 3000 + "0"), ("probe", "- và là của có")] + [(str(n), f"{PROSE} {n}") for n in range(8000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got, want, without = ({tuple(r) for r in kinds(d, words, QualityConfig(learnt=1.0, **c)).collect()} for d, c in ((df, {}), (df, {"fit_docs": len(rows)}), (df.where("doc_id <> 'long'"), {"fit_docs": len(rows)})))
    assert len(got) == len(rows) and got == want
    assert {r for r in got if r[0] == "probe"} != {r for r in without if r[0] == "probe"}
