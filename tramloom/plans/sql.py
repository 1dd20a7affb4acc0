"""Pieces of SQL for the twins of the text functions, in the dialect of the checking database."""

from __future__ import annotations

from tramloom.functions import text as X


def rx(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {rx(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def light(x: str, compose: bool = True) -> str:
    x = f"nfc_normalize(coalesce({x}, ''))" if compose else f"coalesce({x}, '')"
    x = sub(sub(x, X.NO_WIDTH, " "), X.DROPPED, "")
    x = f"translate({x}, {rx(X.PUNCTUATION[0])}, {rx(X.PUNCTUATION[1])})"
    x = sub(sub(x, r"[ \t]+", " "), r" *\n *", "\n")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def key_of_light(x: str) -> str:
    return strip(sub(sub(f"lower({x})", X.NOT_KEY, " "), X.SPACES, " "))


def key(x: str, compose: bool = True) -> str:
    return key_of_light(light(x, compose))


def fold(x: str) -> str:
    x = f"translate(coalesce({x}, ''), {rx(X.MARKED)}, {rx(X.BASE)})"
    return sub(x, r"\p{M}+", "")


def fold_key(x: str) -> str:
    return key(fold(x), compose=False)


def rule_text(x: str) -> str:
    return f"trim({sub(f'lower({fold(x)})', '[^a-z0-9]+', ' ')})"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {rx(X.TOKEN)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern)}))"


def ratio_of(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / greatest({b}, 1)::DOUBLE)"


def digit_ratio(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 1.0::DOUBLE ELSE {ratio_of(count(x, chr(92) + 'p{N}'), f'length({x})')} END)"


def alpha_ratio(x: str) -> str:
    return ratio_of(count(x, r"\p{L}"), f"length({x})")


def punct_ratio(x: str) -> str:
    return ratio_of(count(x, r"\p{P}"), f"length({x})")


def emoji_ratio(x: str) -> str:
    return ratio_of(count(x, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\p{So}\p{Sk}]"), f"length({x})")


def filter_reason(x: str, most: int = 12) -> str:
    n = f"len({tokens(x)})"
    bare = sub(x, r"[\s\p{Z}\p{P}\p{S}]", "")
    return f"""(CASE WHEN trim({x}) = '' THEN 'empty' WHEN length({x}) < 2 THEN 'too_short' WHEN {n} = 0 THEN 'no_tokens' WHEN {n} > {most} THEN 'too_many_tokens'
 WHEN regexp_matches({bare}, {rx('^' + chr(92) + 'p{N}+$')}) THEN 'numeric_only' WHEN {alpha_ratio(x)} = 0 THEN 'no_alpha'
 WHEN {emoji_ratio(x)} > 0.20 THEN 'emoji_heavy' WHEN {punct_ratio(x)} > 0.60 THEN 'punct_heavy' END)"""


def lines(table: str, key: str, text: str) -> str:
    """(key, line_index, text) of the lines that aren't blank."""
    return f"""SELECT {key}, i - 1 AS line_index, {strip('l[i]')} AS text FROM (SELECT {key}, string_split({text}, chr(10)) AS l FROM {table} WHERE {text} IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
 WHERE {strip('l[i]')} <> ''"""


def ngrams(table: str, keys: str, toks: str, low: int, high: int) -> str:
    """(keys, start, n, text) of the n-grams of a token list."""
    return f"""SELECT {keys}, s AS start, n, array_to_string({toks}[s + 1 : s + n], ' ') AS text FROM {table}, unnest(range({low}, {high + 1})) AS a(n), unnest(range(0, greatest(len({toks}) - n + 1, 0))) AS b(s)"""
