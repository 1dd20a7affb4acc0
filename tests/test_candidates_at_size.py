"""Candidate phrases measured once a row: the measures, and the n-grams across a break, against the plain definitions."""

from pyspark.sql import functions as F

from tramloom.functions import text as X
from tramloom.operators import candidates as C, segments as S
from tramloom.plans import queries as core

TEXTS = ["", " ", "a", "ab", "Bún Gạo", "12", "12 345", "a1", "a_b", "_", "x  y", " x", "x ", "x\n", "a-b c.d", "!!", "12!", "²", "½ x", "😀😀 a", "a😀", "日本", "ʼ", "é", "đ" * 30, " ".join("abcdefghijklmn"), "ǅ ø", "ª", "x×y", "…… a", "1 a 2 b 3"]


def test_measures_give_what_the_phrases_give(spark):
    df = spark.createDataFrame([(t, s) for t in TEXTS for s in ("ngram", "line")], "t string, s string")
    df = df.select("*", X.once(C.measures(F.col("t"))).alias("m"))
    for most in (2, 12):
        rows = df.select("t", C.reason_of(F.col("m"), most_tokens=most).alias("a"), C.filter_reason(F.col("t"), most_tokens=most).alias("b"), C.structure_of(F.col("m"), F.col("s"), most).alias("c"), C.structure_score(F.col("t"), F.col("s"), most).alias("d"), F.col("m.n").alias("e"), F.size(X.tokens(F.col("t"))).alias("f")).collect()
        assert not [r for r in rows if (r.a, r.c, r.e) != (r.b, r.d, r.f)] and len({r.a for r in rows}) >= 7


def test_ngrams_across_are_those_that_cross(spark):
    rows = [(list("abcdefgh"[:n]), b) for n in range(2, 9) for b in range(1, n)]
    df = spark.createDataFrame(rows, "t array<string>, b int")
    for low, high in ((1, 1), (1, 3), (2, 6), (3, 9)):
        every = F.filter(S.ngrams(F.col("t"), low, high), lambda g: (g["start"] < F.col("b")) & (g["start"] + g["n"] > F.col("b")))
        assert not df.where(~S.ngrams_across(F.col("t"), F.col("b"), low, high).eqNullSafe(every)).collect()


def test_lines_are_made_light_once(spark, small):
    plan = core.QUERIES["generated_candidates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    # the kinds of candidates read one shuffle of the light lines, and the candidates are shuffled by image alone
    assert plan.count("REPARTITION_BY_COL") >= 2
