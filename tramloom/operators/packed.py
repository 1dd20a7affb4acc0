"""Several values packed in one field: split into one row per value with its place.

Quoted spans (and spans in round brackets) are lifted out of the field and stand as indexed placeholders while the
remaining text is split at its delimiters; each piece then gets its spans back by array lookup. All steps are column
expressions, so the operator is one narrow stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Brackets of a placeholder. Where a field holds these characters itself, they are lifted out like a quoted span, so
#: that a placeholder can't be confused with text.
OPEN, CLOSE = "\ue000", "\ue001"

# Quote pairs, delimiters and list marks of the input format.
QUOTES = [('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("«", "»"), ("「", "」"), ("„", "“")]
NULL_WORDS = ["nan", "none", "null"]
BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
MARKS = r"(?:[-*•·▪‣◦●–—✓✔+]|\(?\d{1,3}[.)])"
HARD = r"[\r\n\t;；|｜•·、‣◦●]"

#: Delimiters: a hard one anywhere; a comma not between digits; a plus or slash that isn't joined to the word before it.
DELIMITER = rf"(?:{HARD}|(?<![0-9])[,，]|[,，](?![0-9])|(?:(?<=[{BLANK}])|^|(?<={HARD}))[+＋/／](?![0-9]*[{CLOSE}]))"


def _span_pattern() -> str:
    """A quoted span opens where a value may begin and closes where one may end.

    Text with doubled quotes is a chain of spans that touch; each is lifted out by itself, and they come back side by
    side. The pattern repeats single characters only, so that it needs no stack however long the span."""
    end = r"[\r\n\t;；|｜,，、•·‣◦●+＋/／\]]"
    spans = [rf"(?<=^|[{BLANK};；|｜,，、•·‣◦●+＋/／\[{b}]){a}[^{b}]*+{b}(?={a}|[{BLANK}]*(?:$|{end}))" for a, b in QUOTES]
    return "|".join([*spans, r"\([^()\r\n]*+\)", f"[{OPEN}{CLOSE}]"])


SPAN = _span_pattern()

#: What every span begins with.
OPENING = "[" + "".join(a for a, _ in QUOTES) + f"({OPEN}{CLOSE}]"

#: What every delimiter holds.
DIVIDING = r"[\r\n\t;；|｜•·、‣◦●,，+＋/／]"

#: List marks and numbers before a value.
LEADING = rf"^[{BLANK}]*(?:{MARKS}[{BLANK}]+|{MARKS}(?={OPEN}|$))+"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def _unquote(x: Column) -> Column:
    """Without the quotes around the value; doubled quotes inside become one."""
    closing = F.create_map(*[F.lit(q) for pair in QUOTES for q in pair])
    last = F.substring(x, -1, 1)
    quoted = (F.length(x) >= 2) & F.coalesce(F.try_element_at(closing, F.substring(x, 1, 1)) == last, F.lit(False))
    return F.when(quoted, F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.concat(last, last), last)).otherwise(x)


def _restore(piece: Column, spans: Column) -> Column:
    """Each placeholder in ``piece`` by its span."""
    parts = F.split(piece, OPEN)
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(
                    F.element_at(spans, (F.substring_index(p, CLOSE, 1).cast("int") + 1)),
                    F.substring(p, F.instr(p, CLOSE) + 1, F.length(p)),
                )
            ),
        ),
        "",
    )


def _array_items(field: Column) -> Column:
    """Elements of a written-out array: as JSON, or else with single quotes; null elements hold no value."""
    inner = F.regexp_replace(field, r"^\[|\]$", "")
    element = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"' + "|" + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'" + r"|[^,\[\]\s\"'][^,\[\]]*"
    raw = F.transform(F.regexp_extract_all(inner, F.lit(f"({element})"), 1), _strip)

    def value(x: Column) -> Column:
        quoted = (F.length(x) >= 2) & (x.startswith('"') & x.endswith('"') | x.startswith("'") & x.endswith("'"))
        bare = F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
        return F.when(quoted, bare).when(F.lower(x).isin(*NULL_WORDS), F.lit("")).otherwise(x)

    return F.coalesce(F.from_json(field, "array<string>"), F.transform(raw, value))


def _hold(parts: Column, spans: Column) -> Column:
    """The text between spans, with a placeholder of its number for each span."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)), "")


def with_values(df: DataFrame, column: str, to: str = "__values") -> DataFrame:
    """``df`` with the array of the values of ``column`` in their order; empty for NULL, blank and null-word fields.

    The steps are projections of their own, so that what several later steps use is worked out once; inside a
    ``transform`` a step uses its own variable only."""
    field = F.col(f"`{column}`")
    df = df.withColumn("__text", _strip(field))
    df = df.withColumn("__null", F.coalesce((F.col("__text") == "") | F.lower("__text").isin(*NULL_WORDS), F.lit(True)))
    df = df.withColumn("__array", ~F.col("__null") & F.col("__text").rlike(r"^\[\s*(?:[\"'].*[\"']|(?i:none|null|nan))?\s*,?\s*\]$"))
    plain = ~F.col("__null") & ~F.col("__array")
    # a span begins with one of these, so a field without them has none
    df = df.withColumn("__spans", F.when(plain & F.col("__text").rlike(OPENING), F.regexp_extract_all("__text", F.lit(f"({SPAN})"), 1)))
    df = df.withColumn("__held", F.when(F.size("__spans") > 0, _hold(F.split("__text", SPAN), F.col("__spans"))).when(plain, F.col("__text")))
    cut = F.when(F.col("__held").rlike(DIVIDING), F.split("__held", DELIMITER)).otherwise(F.array("__held"))
    df = df.withColumn("__pieces", F.transform(cut, lambda p: _strip(F.regexp_replace(p, LEADING, ""))))
    df = df.withColumn("__pieces", F.when(F.size("__spans") > 0, F.transform("__pieces", lambda p: F.when(p.contains(OPEN), _strip(_restore(p, F.col("__spans")))).otherwise(p))).otherwise(F.col("__pieces")))
    df = df.withColumn("__items", F.when(F.col("__array"), _array_items(F.col("__text"))).otherwise(F.transform("__pieces", _unquote)))
    values = F.filter(F.transform("__items", _strip), lambda x: x.isNotNull() & (x != ""))
    out = df.withColumn(to, F.coalesce(values, F.array().cast("array<string>")))
    return out.drop("__text", "__null", "__array", "__spans", "__held", "__pieces", "__items")


def explode_values(df: DataFrame, column: str, pos: str = "item_pos", item: str = "item") -> DataFrame:
    """One row per value of ``column`` with its place from 1. The other columns are kept; the packed field isn't, since
    each of its values would carry the whole of it.

    Defined results: NULL, blank and null-word fields and fields of delimiters only give no row; repeated values each
    keep their row; very long fields are split whole; a quote that never closes is ordinary text; columns of ``df``
    called like ``pos`` or ``item`` are replaced; names that begin with two underscores are the operator's own.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (pos, item, column)]
    # an inner explode would have its non-empty check pushed down, and with it a second run of all the steps
    rows = with_values(df.select(*rest, F.col(f"`{column}`")), column).select(*rest, F.posexplode_outer("__values").alias("__pos", item))
    return rows.where(F.col(item).isNotNull()).select(*rest, (F.col("__pos") + 1).cast("int").alias(pos), item)
