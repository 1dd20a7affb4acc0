"""Quality of read text: junk statistics, report, score, choice of the variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.functions import text as X

# Character classes, bars of the report, and the order in which variants are tried.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
KANA = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]"
HANGUL = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
VARIANT_ORDER = ["hard_fallback", "raw_resized", "soft_enhanced"]
FATAL = ["ocr_error", "no_or_too_few_boxes", "text_too_short", "too_few_alnum_chars", "very_low_avg_conf", "too_many_cjk_kana_hangul_chars", "too_much_junk", "no_alnum_only_symbols"]


def junk_stats(c: Column) -> dict[str, Column]:
    """Counts and ratios of character classes of a text."""
    t = X.empty(c)
    n = F.length(t)
    counts = {"n_chars": n, "alnum_chars": X.count(t, r"[\p{L}\p{N}]"), "alpha_chars": X.count(t, r"\p{L}"), "digit_chars": X.count(t, r"\p{Nd}"), "space_chars": X.count(t, r"[\s\p{Z}]"), "cjk_chars": X.count(t, CJK), "kana_chars": X.count(t, KANA), "hangul_chars": X.count(t, HANGUL), "emoji_chars": X.count(t, EMOJI), "symbol_chars": X.count(t, r"[\p{So}\p{Sk}\p{Cf}\p{Co}]")}
    ratio = lambda x: F.round(X.ratio_of(x, n), 6)
    east = counts["cjk_chars"] + counts["kana_chars"] + counts["hangul_chars"]
    ratios = {"alnum_ratio": ratio(counts["alnum_chars"]), "cjk_ratio": ratio(east), "symbol_ratio": ratio(counts["symbol_chars"]), "junk_ratio": ratio(X.count(t, f"{CJK}|{KANA}|{HANGUL}|{EMOJI}|[\\p{{So}}\\p{{Sk}}\\p{{Cf}}\\p{{Co}}]"))}
    return {k: v.cast("long") for k, v in counts.items()} | ratios


def reasons(error: Column, boxes: Column, text: Column, conf: Column) -> Column:
    """Ordered array of what is wrong with a reading."""
    s = junk_stats(text)
    t = X.strip(X.empty(text))
    checks = [
        (X.empty(error) != "", "ocr_error"),
        (F.coalesce(boxes, F.lit(0)) < 1, "no_or_too_few_boxes"),
        (F.length(t) < 3, "text_too_short"),
        (s["alnum_chars"] < 4, "too_few_alnum_chars"),
        (F.coalesce(conf, F.lit(0.0)) < 0.18, "very_low_avg_conf"),
        ((F.coalesce(conf, F.lit(0.0)) >= 0.18) & (conf < 0.35) & (s["alnum_chars"] < 20), "low_avg_conf_short_text"),
        (s["cjk_ratio"] > 0.20, "too_many_cjk_kana_hangul_chars"),
        (X.emoji_ratio(t) > 0.20, "too_many_emoji_chars"),
        (s["symbol_ratio"] > 0.55, "too_many_symbol_chars"),
        (s["junk_ratio"] > 0.35, "too_much_junk"),
        ((t != "") & (s["alnum_chars"] == 0), "no_alnum_only_symbols"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def quality_score(boxes: Column, text: Column, conf: Column, why: Column, variant: Column) -> Column:
    """Score of a reading from -1 to 1."""
    s = junk_stats(text)
    alnum, n = s["alnum_chars"], F.coalesce(boxes, F.lit(0))
    score = 0.45 * X.clamp(F.coalesce(conf, F.lit(0.0))) + 0.20 * F.least(alnum / 60, F.lit(1.0)) + 0.10 * F.least(n / 10, F.lit(1.0)) + 0.25 * (1 - F.least(s["junk_ratio"], F.lit(1.0)))
    score = score - F.when(F.size(why) > 0, 0.25).otherwise(0.0) + F.when(variant == "soft_enhanced", -0.015).when(variant == "raw_resized", 0.005).otherwise(0.0)
    score = score - F.when(alnum > 180, F.least((alnum - 180) / 600, F.lit(0.10))).otherwise(0.0) - F.when(n > 40, F.least((n - 40) / 150, F.lit(0.06))).otherwise(0.0)
    return X.rounded(F.when(X.strip(X.empty(text)) == "", 0.0).otherwise(X.clamp(score, -1.0, 1.0)))


def is_fatal(why: Column) -> Column:
    return F.arrays_overlap(why, F.array(*[F.lit(x) for x in FATAL]))


def choose_variant(readings: DataFrame, by: str) -> DataFrame:
    """(by, variant, reason, score): the first variant in order without a fatal fault, else the best score."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in VARIANT_ORDER]), F.col("variant")), F.lit(99))
    fine = ~F.col("fatal")
    w = Window.partitionBy(by).orderBy(F.desc(fine), F.when(fine, order).otherwise(0), F.desc("score"), order)
    reason = F.when(fine & (F.col("variant") == VARIANT_ORDER[0]), "hard_first_non_fatal").when(fine, "best_non_fatal").otherwise("best_overall")
    return readings.withColumn("r", F.row_number().over(w)).where("r = 1").select(by, "variant", reason.alias("reason"), "score")


def read_variants(lines: DataFrame, by: str, variant: str, text: str, conf: str, order: list[str]) -> DataFrame:
    """(by, variant, text, conf, boxes): readings of each variant from its lines; a page bounds the group."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    g = lines.where(F.col(text).isNotNull()).groupBy(by, F.col(variant).alias("variant"))
    return g.agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text"), F.avg(F.when((F.col(conf) >= 0) & (F.col(conf) <= 1), F.col(conf))).alias("conf"), F.count("*").alias("boxes"))


def plainly_bad(error: Column, text: Column, boxes: Column, conf: Column, least_chars: int = 4, least_conf: float = 0.35, least_boxes: int = 1) -> Column:
    """A simpler test of a reading: an error, no text, too few boxes or letters, or little text of low confidence."""
    t = X.strip(X.empty(text))
    alnum = X.count(t, r"[\p{L}\p{N}]")
    return (X.empty(error) != "") | (t == "") | (F.coalesce(boxes, F.lit(0)) < least_boxes) | (alnum < least_chars) | ((F.coalesce(conf, F.lit(0.0)) < least_conf) & (alnum < 20))


def plain_score(text: Column, boxes: Column, conf: Column, bad: Column) -> Column:
    """Score of a reading by the simpler test, from 0 to 1."""
    alnum = X.count(X.empty(text), r"[\p{L}\p{N}]")
    score = 0.65 * X.clamp(F.coalesce(conf, F.lit(0.0))) + 0.25 * F.least(alnum / 80, F.lit(1.0)) + 0.10 * F.least(F.coalesce(boxes, F.lit(0)) / 12, F.lit(1.0))
    return X.rounded(F.when(bad, score * 0.65).otherwise(score))


def keep_primary(readings: DataFrame, by: str, primary: str) -> DataFrame:
    """(by, variant, reason, score): the primary variant unless it is bad, else the best score, ties by the variants' order.
    ``readings`` has ``bad`` and ``score``."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in VARIANT_ORDER]), F.col("variant")), F.lit(99))
    good = (F.col("variant") == primary) & ~F.col("bad")
    w = Window.partitionBy(by).orderBy(F.desc(good), F.desc("score"), order)
    return readings.withColumn("r", F.row_number().over(w)).where("r = 1").select(by, "variant", F.when(good, "primary").otherwise("best_score").alias("reason"), "score")
