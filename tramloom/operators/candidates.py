"""Candidate phrases: filters, scores, deduplication, agreement of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.functions import text as X

# Weights of the candidate sources and of the structure score.
SOURCE_SCORE = {"line": 1.00, "whole_line": 0.95, "segment": 0.85, "ngram": 0.70}
SOURCE_PRIORITY = {"line": 4, "whole_line": 3, "segment": 2, "ngram": 1}
FILTER_SCORE = {"empty": 0.0, "too_short": 0.25, "no_tokens": 0.0, "too_many_tokens": 0.55, "numeric_only": 0.15, "no_alpha": 0.10, "emoji_heavy": 0.20, "punct_heavy": 0.20}


def by_value(c: Column, values: dict[str, float], default: float | None) -> Column:
    out = F.lit(default) if default is not None else F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


#: Texts of composed Latin letters, digits and single blanks, whose measures need no patterns.
_WORD = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1EA0}-\x{1EF9}]++"
SIMPLE = rf"^{_WORD}(?: {_WORD})*+\z"


def measures(c: Column) -> Column:
    """What the filters and the structure score ask of a phrase, as one struct: blank, length, n (tokens), token_chars, numeric,
    and the shares alpha, digit, emoji and punct. Worked out once a row by ``X.once``, they serve all of them."""
    def struct(blank: Column, n: Column, chars: Column, numeric: Column, alpha: Column, digit: Column, emoji: Column, punct: Column) -> Column:
        return F.struct(blank.alias("blank"), F.length(c).alias("length"), n.alias("n"), chars.alias("token_chars"), numeric.alias("numeric"), alpha.alias("alpha"), digit.alias("digit"), emoji.alias("emoji"), punct.alias("punct"))

    length, without = F.length(c), lambda chars: F.length(F.translate(c, chars, ""))
    chars, digits, t = without(" "), length - without("0123456789"), X.tokens(c)
    alphas = chars - digits
    simple = struct(F.lit(False), length - chars + 1, chars, alphas == 0, X.ratio_of(alphas, length), X.ratio_of(digits, length), F.lit(0.0), F.lit(0.0))
    numeric = F.regexp_replace(c, r"[\s\p{Z}\p{P}\p{S}]", "").rlike(r"^\p{N}+$")
    return F.when(c.rlike(SIMPLE), simple).otherwise(struct(F.trim(c) == "", F.size(t), F.length(F.array_join(t, "")), numeric, X.alpha_ratio(c), X.digit_ratio(c), X.emoji_ratio(c), X.punct_ratio(c)))


def filter_reason(c: Column, least_chars: int = 2, most_tokens: int = 12) -> Column:
    """First reason to drop a phrase, or NULL."""
    n_tokens = F.size(X.tokens(c))
    numeric = F.regexp_replace(c, r"[\s\p{Z}\p{P}\p{S}]", "").rlike(r"^\p{N}+$")
    return _reason(F.trim(c) == "", F.length(c), n_tokens, numeric, X.alpha_ratio(c), X.emoji_ratio(c), X.punct_ratio(c), least_chars, most_tokens)


def reason_of(m: Column, least_chars: int = 2, most_tokens: int = 12) -> Column:
    """``filter_reason`` by the phrase's ``measures``."""
    return _reason(m["blank"], m["length"], m["n"], m["numeric"], m["alpha"], m["emoji"], m["punct"], least_chars, most_tokens)


def _reason(blank: Column, length: Column, n_tokens: Column, numeric: Column, alpha: Column, emoji: Column, punct: Column, least_chars: int, most_tokens: int) -> Column:
    return (
        F.when(blank, "empty")
        .when(length < least_chars, "too_short")
        .when(n_tokens == 0, "no_tokens")
        .when(n_tokens > most_tokens, "too_many_tokens")
        .when(numeric, "numeric_only")
        .when(alpha == 0, "no_alpha")
        .when(emoji > 0.20, "emoji_heavy")
        .when(punct > 0.60, "punct_heavy")
    )


def structure_score(c: Column, source: Column, most_tokens: int = 12) -> Column:
    """How much a phrase is built like a name, from 0 to 1, to four places."""
    t = X.tokens(c)
    return _structure(F.size(t), F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x)), X.alpha_ratio(c), X.digit_ratio(c), filter_reason(c, most_tokens=most_tokens), source)


def structure_of(m: Column, source: Column, most_tokens: int = 12) -> Column:
    """``structure_score`` by the phrase's ``measures``."""
    return _structure(m["n"], m["token_chars"], m["alpha"], m["digit"], reason_of(m, most_tokens=most_tokens), source)


def _structure(n: Column, chars: Column, alpha: Column, digit: Column, reason: Column, source: Column) -> Column:
    length = chars / F.greatest(n, F.lit(1))
    score = F.lit(0.55) + F.when((n >= 1) & (n <= 4), 0.18).when((n >= 5) & (n <= 8), 0.10).otherwise(-0.05)
    score = score + F.when((length >= 2) & (length <= 10), 0.08).otherwise(0.0) + F.when(alpha >= 0.45, 0.10).otherwise(0.0)
    score = score - F.when(digit > 0.50, 0.15).otherwise(0.0) - F.when((source == "ngram") & (n == 1), 0.08).otherwise(0.0)
    return X.rounded(F.when(reason.isNotNull(), by_value(reason, FILTER_SCORE, 0.0)).otherwise(X.clamp(score)))


def position_score(box: Column, width: Column, height: Column) -> Column:
    """How central and large a box is; NULL without a box or page size."""
    x, y, w, h = (box[i].cast("double") for i in range(4))
    cx, cy = x + w / 2, y + h / 2
    off = F.abs(cx - width / 2) / (width / 2) + F.abs(cy - height / 2) / (height / 2)
    score = 0.50 * F.greatest(F.lit(0.0), 1 - 0.5 * off) + 0.35 * F.least(F.lit(1.0), w * h / (width * height) * 8) + 0.15 * F.when(cy <= 0.65 * height, 1.0).otherwise(0.8)
    good = box.isNotNull() & (F.size(box) == 4) & (width > 0) & (height > 0) & (w > 0) & (h > 0)
    return F.when(good, X.rounded(X.clamp(score)))


def source_score(c: Column) -> Column:
    return by_value(c, SOURCE_SCORE, 0.60)


def source_priority(c: Column) -> Column:
    return by_value(c, SOURCE_PRIORITY, 0).cast("int")


def dedupe(df: DataFrame, by: list[str], key: str, rank: list[Column], seq: str) -> DataFrame:
    """The best row of each (by, key), the first in ``seq`` among equals; blank keys are dropped.

    An arg-max aggregate, so a hot key is combined before the shuffle and no group is held in one task."""
    rows = F.struct(*[r.alias(f"__k{i}") for i, r in enumerate(rank)], (-F.col(seq).cast("long")).alias("__seq"))
    best = df.where(F.coalesce(F.trim(F.col(key)) != "", F.lit(False))).groupBy(*by, key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*by, key)]), rows).alias("__row"))
    return best.select(*by, key, "__row.*")


def agreement(df: DataFrame, by: str, key: str, variant: str) -> DataFrame:
    """(by, key, support, available, agreement): variants in which a key occurs, and their share of the variants read."""
    support = df.where(F.trim(F.col(key)) != "").groupBy(by, key).agg(F.count_distinct(variant).alias("support"))
    available = df.groupBy(by).agg(F.count_distinct(variant).alias("available"))
    share = F.when(F.col("available") >= 2, F.round(F.col("support") / F.col("available"), 4)).otherwise(0.0)
    return support.join(available, by).withColumn("agreement", share)


def ranked(df: DataFrame, by: str, order: list[Column], top: int | None = None) -> DataFrame:
    """``df`` with ``rank`` from 1 within ``by``; with ``top``, the first of them."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.where(F.col("rank") <= top) if top else out


def ranked_by_evidence(df: DataFrame, by: str, top: int | None = None, least_tokens: int = 0) -> DataFrame:
    """``df`` with ``rank``: by source, tokens up to eight, agreement of variants, structure, confidence and length, all
    descending, ties by ``seq``; with ``top`` the first of each group that have ``least_tokens``."""
    order = [F.desc(source_priority(F.col("source"))), F.desc(F.least(F.coalesce("token_count", F.lit(0)), F.lit(8))), F.desc(F.coalesce("agreement", F.lit(0.0))), F.desc(F.coalesce("structure_score", F.lit(0.0))), F.desc(F.coalesce("conf", F.lit(0.0))), F.desc(F.length(X.empty(F.col("clean_text")))), F.asc("seq")]
    return ranked(df.where(F.col("token_count") >= least_tokens) if least_tokens else df, by, order, top)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, record): each row as one JSON record."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns])).alias("record"))
