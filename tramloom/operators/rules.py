"""A rule engine over texts: a registry of patterns given as a table, hits, resolution by priority, short-word rejection.

The registry is data of the caller; none is shipped. Each rule is (name, priority, score, canonical name, alternatives).
An alternative gives folded words with ``|`` between them, which must stand in the text in that order with anything
between them; alternatives are tried in order and the first that fits is the hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tramloom.functions import text as X

MAX_RULES = 10_000

def pattern(words: str) -> str:
    """Pattern of words in order on a text of a-z, 0-9 and blanks."""
    return r".*".join(rf"\b{w}\b" for w in words.split("|"))


def registry(spark: SparkSession, rules: list[tuple[str, int, float, str, list[str]]]) -> DataFrame:
    """(rule, priority, score, canonical, seq, pattern): one row an alternative."""
    rows = [(r, p, s, c, i, pattern(a)) for r, p, s, c, alts in rules for i, a in enumerate(alts)]
    return spark.createDataFrame(rows, "rule string, priority int, score double, canonical string, seq int, pattern string")


def hits(texts: DataFrame, key: str, column: str, rules: DataFrame) -> DataFrame:
    """(key, rule, canonical, priority, score): at most one hit of each rule on each text.

    The rules are a query set against all texts: their number is checked, and each text is normalised once. The rules
    ride along as an array, so the patterns are tried in one narrow stage without a join."""
    n = rules.limit(MAX_RULES + 1).count()
    if n > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} patterns; apply the registry in parts")
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("rule", "seq", "pattern", "canonical", "priority", "score"))).alias("rules"))
    t = texts.select(key, X.rule_text(F.col(column)).alias("norm")).where("norm <> ''").crossJoin(F.broadcast(listed))  # one row on the right
    hit = t.select(key, F.explode(F.filter("rules", lambda r: F.rlike(F.col("norm"), r["pattern"]))).alias("r")).select(key, "r.*")
    first = hit.groupBy(key, "rule").agg(F.min_by(F.struct("canonical", "priority", "score"), "seq").alias("h"))
    return first.select(key, "rule", "h.canonical", "h.priority", "h.score")


def resolve(found: DataFrame, key: str) -> DataFrame:
    """The best hit of each text: by priority, score, length of the name, then rule and name."""
    w = Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("score"), F.desc(F.length("canonical")), "rule", "canonical")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def rejected(c: Column, words: tuple[str, ...] = ()) -> Column:
    """True for a phrase that is blank or, folded, one of ``words``, a list of the caller's."""
    t = X.rule_text(c)
    return (t == "") | t.isin(*words) if words else t == ""


def of_group(rules: DataFrame, *groups: str) -> DataFrame:
    """The rules of some groups; ``rules`` has a column ``grp``."""
    return rules.where(F.col("grp").isin(*groups))


def in_context(c: Column, positive: list[str], negative: list[str]) -> Column:
    """Does a text hold one of the ``positive`` patterns and none of the ``negative`` ones? Patterns are on folded words."""
    t = X.rule_text(c)
    any_ = lambda ps: t.rlike("|".join(f"(?:{p})" for p in ps)) if ps else F.lit(False)
    return any_(positive) & ~any_(negative)


def keep_candidate(c: Column, full_text: Column, words: tuple[str, ...] = (), doubtful: dict[str, tuple[list[str], list[str]]] | None = None) -> Column:
    """Is a candidate kept beside the text that it stands in? Not if it is blank or one of ``words``; one of ``doubtful`` only
    in the context that its patterns (positive, negative) ask for. With a blank text all but blank candidates are kept."""
    keep = ~rejected(c, words)
    for word, (positive, negative) in (doubtful or {}).items():
        keep = keep & ((X.rule_text(c) != word) | in_context(full_text, positive, negative))
    return (X.rule_text(c) != "") & (keep | (X.rule_text(full_text) == ""))


def resolve_with(found: DataFrame, extra: DataFrame, key: str, texts: DataFrame, column: str, generic: list[str] | None = None, words: tuple[str, ...] = (), least: int = 95) -> DataFrame:
    """(key, rule, canonical, priority, score): the best of the rules' hits and of ``extra`` (key, canonical), which counts as
    priority 80 and score 0.9 and falls out if it is one of ``words``. A text of ``generic`` patterns alone needs ``least``
    priority."""
    more = extra.where(~rejected(F.col("canonical"), words)).select(key, F.lit("candidate").alias("rule"), "canonical", F.lit(80).alias("priority"), F.lit(0.9).alias("score"))
    best = resolve(found.select(key, "rule", "canonical", "priority", "score").unionByName(more), key)
    topic = texts.select(key, in_context(F.col(column), generic or [], []).alias("__generic"))
    return best.join(topic, key).where(~F.col("__generic") | (F.col("priority") >= least)).select(key, "rule", "canonical", "priority", "score")


def aliases(rules: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(alias, canonical): curated aliases, and the folded words of every rule's name where none is curated."""
    own = rules.select(X.rule_text(F.col("canonical")).alias("alias"), "canonical").where("alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return own if curated is None else curated.select("alias", "canonical").unionByName(own.join(curated, "alias", "left_anti"))


def lexicon_hits(texts: DataFrame, key: str, column: str, lexicon: list[str]) -> DataFrame:
    """(key, hits, n_hits): distinct folded phrases of a lexicon that occur in a text."""
    t = texts.select(key, X.rule_text(F.col(column)).alias("norm"))
    found = F.array_sort(F.filter(F.array_distinct(F.array(*[F.lit(x) for x in lexicon])), lambda p: F.contains(F.col("norm"), p)))
    return t.select(key, F.array_join(found, "|").alias("hits"), F.size(found).alias("n_hits"))
