"""Text functions as column expressions; only Unicode composition (NFC) leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tramloom.functions.workers import per_worker

# Character classes of the text forms.
LETTERS = r"0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1EF9}\x{110}\x{111}"
TOKEN = rf"[{LETTERS}]+(?:[._/-][{LETTERS}]+)*"
NO_WIDTH = r"[\x{200B}-\x{200F}\x{FEFF}]"
DROPPED = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{So}\p{Sk}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
NOT_KEY = r"[^\p{L}\p{N}_\s\p{Z}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1EF9}]+"
SPACES = r"[\s\p{Z}]+"
PUNCTUATION = ("–—−“”’‘", "---\"\"''")
OUTPUT_ALLOWED = r"[^\x20-\x7E\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{300}-\x{36F}\x{2010}-\x{2027}\x{20AB}\s]+"
READABLE = r"[0-9A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]{3,}"
NULL_WORDS = ("nan", "none", "null")
TRUE_WORDS = ("1", "true", "yes", "y", "t")


def _accents() -> tuple[str, str]:
    """Letters with marks that have a Latin base, and those bases, by rule."""
    marked, base = [], []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(i)
        plain = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if plain != ch and len(plain) == 1:
            marked.append(ch)
            base.append(plain)
    return "".join(marked) + "đĐ", "".join(base) + "dD"


MARKED, BASE = _accents()


@pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: Characters that stay as they are in composed text whatever stands beside them, if no other character does.
SETTLED = r"\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{1EA0}-\x{1EF9}\x{2010}-\x{2027}\x{20AB}\x{2600}-\x{27BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}"


def nfc(c: Column) -> Column:
    """``c`` with composed letters. Only texts with a character that may compose go to Python, the others as NULL."""
    return F.coalesce(_nfc(F.when(c.rlike(f"[^{SETTLED}]"), c)), c)


def empty(c: Column) -> Column:
    """NULL as the empty text."""
    return F.coalesce(c, F.lit(""))


def safe_text(c: Column) -> Column:
    """NULL and the words nan, none and null (any case, trimmed) as the empty text."""
    return F.when(c.isNull() | F.lower(F.trim(c)).isin(*NULL_WORDS), F.lit("")).otherwise(c)


def safe_double(c: Column, default: float | None = None) -> Column:
    x = c.try_cast("double")
    return x if default is None else F.coalesce(x, F.lit(default))


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def odd(c: Column, least: int = 1) -> Column:
    """The next odd number from ``c`` or ``least``, whichever is larger."""
    x = F.greatest(c.cast("int"), F.lit(least))
    return x + F.when(x % 2 == 0, 1).otherwise(0)


def rounded(c: Column, digits: int = 4) -> Column:
    """``c`` to ``digits`` places, without the noise of its last bits deciding a tie."""
    return F.round(F.round(c, 9), digits)


def light(c: Column, compose: bool = True) -> Column:
    """Light normal form: NULL as empty, composed, without controls, emoji and other symbols, plain dashes and quotes,
    single blanks, no blanks around breaks, at most one empty line. ``compose=False`` is for text known to be NFC."""
    x = nfc(empty(c)) if compose else empty(c)
    x = F.regexp_replace(x, NO_WIDTH, " ")
    x = F.regexp_replace(x, DROPPED, "")
    x = F.translate(x, *PUNCTUATION)
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


#: Texts of composed Latin letters, digits and single blanks: but for their case they are their own key.
_WORD = r"[0-9A-Za-z_\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1EA0}-\x{1EF9}]++"
PLAIN = rf"^{_WORD}(?: {_WORD})*+\z"


def key(c: Column, compose: bool = True) -> Column:
    """Match key: light form in lower case, of letters, digits and single blanks."""
    return F.when(c.rlike(PLAIN), F.lower(c)).otherwise(key_of_light(light(c, compose)))


def once(c: Column) -> Column:
    """``c`` as a generator of one row, for ``select``: filters and expressions over it then don't work it out again."""
    return F.explode_outer(F.array(c))


def key_of_light(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), NOT_KEY, " ")
    return strip(F.regexp_replace(x, SPACES, " "))


def fold(c: Column) -> Column:
    """``c`` without accents (đ is d); composed and decomposed text give the same, so no composition is needed."""
    return F.regexp_replace(F.translate(empty(c), MARKED, BASE), r"\p{M}+", "")


def fold_key(c: Column) -> Column:
    return key(fold(c), compose=False)


def rule_text(c: Column) -> Column:
    """Folded lower-case words of a-z and 0-9, for patterns."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Tokens: runs of letters and digits, joined by single ``. _ / -``."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def detokenize(c: Column) -> Column:
    return F.trim(F.array_join(c, " "))


def strip_fillers(c: Column, fillers: Column) -> Column:
    """Tokens that aren't in the array ``fillers``; an empty array changes nothing."""
    return F.filter(c, lambda t: ~F.array_contains(fillers, F.lower(t)))


def token_keys(c: Column) -> Column:
    """Sorted distinct keys of the tokens of ``c``, which must be in light form."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens(c), key_of_light), lambda t: t != "")))


def folded_token_keys(c: Column) -> Column:
    return token_keys(fold(c))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def ratio_of(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(ratio_of(count(c, r"\p{N}"), F.length(c)))


def alpha_ratio(c: Column) -> Column:
    return ratio_of(count(c, r"\p{L}"), F.length(c))


def punct_ratio(c: Column) -> Column:
    return ratio_of(count(c, r"\p{P}"), F.length(c))


def emoji_ratio(c: Column) -> Column:
    return ratio_of(count(c, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\p{So}\p{Sk}]"), F.length(c))


def compact_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(empty(c), SPACES, ""))


def output_text(c: Column, compose: bool = True) -> Column:
    """Product text for output: NULL words empty, composed, one line, `` + `` around each plus."""
    x = F.regexp_replace(nfc(safe_text(c)) if compose else safe_text(c), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"\s*\+\s*", " + ")
    return strip(F.regexp_replace(x, SPACES, " "))


def output_ocr_text(c: Column) -> Column:
    """Read text for output: composed, single blanks, breaks kept, at most one empty line."""
    x = F.regexp_replace(nfc(safe_text(c)), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_ocr_text(c: Column, drop_junk: bool = True) -> Column:
    """Read text on one line of allowed characters; without a readable run of three it is empty."""
    x = F.regexp_replace(output_ocr_text(c), OUTPUT_ALLOWED, " ")
    x = strip(F.regexp_replace(x, SPACES, " "))
    return F.when(x.rlike(READABLE), x).otherwise(F.lit("")) if drop_junk else x


def display_key(c: Column) -> Column:
    """Key of a display name: folded, lower case, pluses kept."""
    x = F.regexp_replace(F.lower(fold(output_text(c, compose=False))), rf"[^{LETTERS}\s+]", " ")
    return strip(F.regexp_replace(x, SPACES, " "))


def cer_text(c: Column, lower: bool = False) -> Column:
    x = strip(F.regexp_replace(nfc(empty(c)), SPACES, " "))
    return F.lower(x) if lower else x


def shorten(c: Column, limit: int = 120) -> Column:
    x = F.regexp_replace(empty(c), r"\n", " / ")
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 3), F.lit("..."))).otherwise(x)


def confidence(c: Column) -> Column:
    """Below 0: -1; above 1: a percentage."""
    return F.when(c.isNull() | (c < 0), F.lit(-1.0)).when(c > 1, c / 100).otherwise(c)


def parse_list(c: Column) -> Column:
    """Blank-free elements of a JSON list, or the text itself as the only element."""
    parsed = F.from_json(c, "array<string>")
    whole = F.coalesce(F.when(c.startswith("["), parsed), F.array(c))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(whole, lambda x: F.trim(x) != ""))


def cer(prediction: Column, truth: Column, lower: bool = False) -> Column:
    """Character error rate; with an empty truth 0 for an empty prediction, else 1."""
    p, t = cer_text(prediction, lower), cer_text(truth, lower)
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(p, t) / F.length(t))


def box_of(points: Column) -> Column:
    """(x, y, w, h) of an array of points [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def union_box(boxes: Column) -> Column:
    """Smallest (x, y, w, h) around an array of such boxes."""
    x0, y0 = F.array_min(F.transform(boxes, lambda b: b[0])), F.array_min(F.transform(boxes, lambda b: b[1]))
    x1, y1 = F.array_max(F.transform(boxes, lambda b: b[0] + b[2])), F.array_max(F.transform(boxes, lambda b: b[1] + b[3]))
    return F.when(F.size(boxes) > 0, F.array(x0, y0, x1 - x0, y1 - y0))


def entry_id(canonical_key: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit("entry:"), canonical_key)), 1, 12)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("F", "T", "pd", "Column", "pandas_udf", "unicodedata", "per_worker", "annotations")]
