"""Visually identical text with different characters, brought to one form.

Confusables skeleton: a text is decomposed, every character replaced by its prototype from the public confusables table
(``confusables.py``), and decomposed again; texts of equal skeleton look alike. The form of a text takes the same steps
with the ordinary letter that a character looks like in place of its prototype, so that ordinary text stays as it is,
and composes at the end. Most texts are in their form already; a regular expression finds those inside the JVM, so only
the others travel to Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tramloom.functions.workers import per_worker
from tramloom.llm import confusables
from tramloom.llm.codes import LOOKALIKES

#: A text of these characters only, without doubled blanks or blanks at its ends, is its own form.
UNUSUAL = rf"[^ -~{confusables.VIETNAMESE_CLASS}]|  |^ | $"
BLANK = r"^[\s\p{Z}\p{Cf}\p{Cc}]*$"

#: Punctuation that looks like ASCII punctuation.
PUNCTUATION = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "′": "'", "″": '"', "…": "...", "⁄": "/", "∕": "/"}


class Tables:
    """What ``form`` and ``skeleton`` look up, built once a worker from the prototypes."""

    def __init__(self, proto: dict[str, str]) -> None:
        self.chars: dict[int, str | None] = {}
        for i in [*range(0x80, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
            ch = chr(i)
            kind = unicodedata.category(ch)
            if kind == "Cf" or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
                self.chars[i] = None
            elif kind in ("Zs", "Zl", "Zp"):
                self.chars[i] = " "
            elif 0xFF01 <= i <= 0xFF5E or 0x1D400 <= i < 0x1D800:
                self.chars[i] = unicodedata.normalize("NFKC", ch)
        self.chars |= {ord(a): b for a, b in PUNCTUATION.items()}
        latin, other = confusables.letters(proto)
        self.latin = {ord(a): b for a, b in latin.items()}
        self.whole = self.latin | {ord(a): b for a, b in LOOKALIKES.items()}
        self.mixed = self.latin | {ord(a): b for a, b in other.items()}
        self.trigger = frozenset(latin) | frozenset(other)
        self.proto = {ord(a): b for a, b in proto.items()}
        self.scripts: dict[str, str] = {}

    def script(self, ch: str) -> str:
        """The script of a letter that isn't Latin, else an empty text."""
        if ch not in self.scripts:
            name = unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""
            self.scripts[ch] = "" if ord(ch) in self.latin or name == "LATIN" else name
        return self.scripts[ch]


def form(text: str, t: Tables) -> str:
    """``text`` as it looks. In a word with a Latin letter, letters of other scripts become the Latin ones that they look
    like, unless one of them looks like none. A word of another script alone keeps its letters, unless all of them have
    the very shape of Latin ones and no other word of the text is truly of that script."""
    out = unicodedata.normalize("NFC", text.translate(t.chars))
    if t.trigger.isdisjoint(out):
        return " ".join(out.split())
    words = [unicodedata.normalize("NFD", w) for w in out.split()]
    latin = [any("a" <= c.lower() <= "z" for c in w) for w in words]
    maps = [t.mixed if x else t.whole for x in latin]
    kinds = [({t.script(c) for c in w} - {""}, {t.script(c) for c in w if ord(c) not in m} - {""}) for w, m in zip(words, maps)]
    true = set().union(*(own for _, own in kinds))
    keep = [bool(own) or (bool(has) and not x and has <= true) for (has, own), x in zip(kinds, latin)]
    return " ".join(unicodedata.normalize("NFC", w.translate(t.latin if k else m)) for w, k, m in zip(words, keep, maps))


def skeleton(text: str, t: Tables) -> str:
    """Prototypes of the decomposed characters of a text, decomposed; the text without characters of no width and with
    single blanks."""
    plain = " ".join(text.translate(t.chars).split())
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", plain).translate(t.proto))


def _by_text(spark: SparkSession, f):
    held = spark.sparkContext.broadcast(confusables.prototypes(spark))  # one table of the Unicode standard

    @pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = per_worker("lookalike_tables", lambda: Tables(held.value))
        for s in batches:
            yield s.map(lambda x: f(x, t), na_action="ignore")

    return run


def forms(c: Column, spark: SparkSession) -> Column:
    return _by_text(spark, form)(c)


def changed(df: DataFrame, row_id: str, column: str, src: str) -> DataFrame:
    """(src, row_id, form): rows whose text isn't blank and differs from its form.

    Defined results: NULL and blank texts (only blanks, controls and characters of no width) give no row; repeated
    texts each give theirs; very long texts are treated whole; other columns of ``df`` don't matter.
    """
    text = F.col(f"`{column}`")
    odd = df.where(text.rlike(UNUSUAL) & ~text.rlike(BLANK)).select(F.col(f"`{row_id}`").cast("string").alias("row_id"), text.alias("__text"))
    out = odd.withColumn("form", forms(F.col("__text"), df.sparkSession))
    return out.where((F.col("form") != F.col("__text")) & (F.col("form") != "")).select(F.lit(src).alias("src"), "row_id", "form")


def with_form(df: DataFrame, column: str, to: str = "form") -> DataFrame:
    """``df`` with the form of ``column``; NULL stays NULL. Texts in their form already skip Python."""
    text = F.col(f"`{column}`")
    odd = df.where(text.rlike(UNUSUAL)).withColumn(to, forms(text, df.sparkSession))
    same = df.where(~text.rlike(UNUSUAL) | text.isNull()).withColumn(to, text)
    return same.unionByName(odd)


def groups(df: DataFrame, column: str) -> DataFrame:
    """(skeleton, n_spellings, n_rows): texts that look alike, for skeletons with more than one spelling.

    Rows are counted by spelling first, so that a hot text is one row before the second count. NULL and blank texts are
    in no group."""
    text = F.col(f"`{column}`")
    by = df.where(text.isNotNull() & ~text.rlike(BLANK)).groupBy(text.alias("__text")).agg(F.count("*").alias("n"))
    by = by.withColumn("skeleton", _by_text(df.sparkSession, skeleton)("__text"))
    return by.groupBy("skeleton").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows")).where("n_spellings > 1")
