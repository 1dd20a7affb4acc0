"""The public table of confusable characters (Unicode Technical Standard 39), as the ICU library inside Spark holds it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

from tramloom.llm.codes import LATIN_LOOKALIKES, LOOKALIKES

_BELOW = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯư"
VIETNAMESE = _BELOW + "".join(map(chr, range(0x1EA0, 0x1EFA)))
VIETNAMESE_CLASS = _BELOW + "Ạ-ỹ"  # the same as part of a pattern
_KEPT: dict[str, dict[str, str]] = {}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Characters with a prototype other than themselves, and that prototype: the skeleton of each, in one call."""
    app = spark.sparkContext.applicationId
    if app not in _KEPT:
        chars = [c for c in map(chr, range(0x21, 0x20000)) if c.isprintable()]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton("\n".join(chars)).split("\n")
        _KEPT.clear()
        _KEPT[app] = {c: p for c, p in zip(chars, found) if p != c}
    return _KEPT[app]


def letters(proto: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Letters beside the ordinary ones, with the ordinary letter or letters that they look like: (Latin letters and
    compatibility forms, letters of other scripts).

    A letter looks like the ordinary one of equal prototype and case, or like its compatibility form where that is of
    ordinary letters; raised and lowered letters keep their place."""
    ordinary = {chr(i) for i in range(0x21, 0x7F)} | set(VIETNAMESE)
    alike: dict[str, list[str]] = {}
    for a in sorted(ordinary):
        if a.isalpha():
            alike.setdefault(proto.get(a, unicodedata.normalize("NFD", a)), []).append(a)
    latin, other = {}, {}
    for c in map(chr, range(0xA1, 0x20000)):
        kind = unicodedata.category(c)
        if c in ordinary or kind[0] != "L" and kind not in ("Nl", "So"):
            continue
        raised = unicodedata.decomposition(c).startswith(("<super>", "<sub>"))
        compat = unicodedata.normalize("NFKC", c)
        if compat != c and set(compat) <= ordinary:
            if not raised and (kind != "So" or "<circle>" in unicodedata.decomposition(c)):
                latin[c] = compat
            continue
        same = [a for a in alike.get(proto.get(c, ""), ()) if a.isupper() == c.isupper()]
        if same and kind != "So":
            (latin if "LATIN" in unicodedata.name(c, "") or kind == "Nl" else other)[c] = same[0]
    return latin | LATIN_LOOKALIKES, other | LOOKALIKES
