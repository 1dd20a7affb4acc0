"""Evidence of linked candidates by document, and the confidence gate over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.functions import text as X
from tramloom.operators.candidates import source_score
from tramloom.operators.linker import HIGH_TRUST


@dataclass(frozen=True)
class GateConfig:
    """Weights and bars of the gate."""

    match: float = 0.42
    margin: float = 0.14
    structure: float = 0.10
    source: float = 0.08
    ocr: float = 0.08
    variant: float = 0.05
    position: float = 0.04
    prior: float = 0.04
    margin_scale: float = 12.0
    least_match: float = 88.0
    least_margin: float = 5.0
    weak_margin: float = 8.0
    strong_bar: float = 0.72
    weak_bar: float = 0.82
    most_items: int = 4
    ambiguous_gap: float = 0.05
    coverage: float = 0.70
    least_parts: int = 2
    positive: float = 0.05
    negative: float = 0.06
    most_negative: float = 0.24
    many_negative: int = 3
    some_negative: int = 2
    low_margin: float = 10.0
    rule_override: int = 90
    rule_strong: int = 95


def high_trust(c: Column) -> Column:
    return c.isin(*HIGH_TRUST)


def prior_score(prior: Column, most: Column) -> Column:
    return F.when((prior > 0) & (most > 0), X.clamp(F.log1p(prior) / F.log1p(most))).otherwise(0.0)


def gate_score(score: Column, margin: Column, structure: Column, source: Column, conf: Column, agreement: Column, available: Column, position: Column, prior: Column, most_prior: Column, match_type: Column, positive: Column | None = None, negative: Column | None = None, cfg: GateConfig = GateConfig()) -> Column:
    """Weighted evidence for one linked candidate, from 0 to 1, to four places; missing values take their defaults. Variants
    count by their agreement where two or more were read; ``positive`` and ``negative`` are phrases of its context."""
    ocr = F.when(conf.isNull(), 0.65).when(conf <= 0, 0.55).otherwise(X.clamp(conf))
    pos = F.when(position.isNull() | (position <= 0), 0.50).otherwise(X.clamp(position))
    agree = F.when(F.coalesce(available, F.lit(0)) < 2, 0.0).otherwise(X.clamp(F.coalesce(agreement, F.lit(0.0))))
    total = (
        cfg.match * score / 100
        + cfg.margin * X.clamp(margin / cfg.margin_scale)
        + cfg.structure * F.coalesce(structure, F.lit(0.60))
        + cfg.source * source_score(source)
        + cfg.ocr * ocr
        + cfg.variant * agree
        + cfg.position * pos
        + cfg.prior * prior_score(prior, most_prior)
    )
    if positive is not None:
        total = total + cfg.positive * F.least(F.coalesce(positive, F.lit(0)) / 3, F.lit(1.0))
    if negative is not None:
        total = total - F.least(cfg.negative * F.coalesce(negative, F.lit(0)), F.lit(cfg.most_negative))
    total = total - F.when(match_type.contains("partial"), 0.04).otherwise(0.0) - F.when((margin < 3) & ~high_trust(match_type), 0.06).otherwise(0.0)
    return X.rounded(X.clamp(total))


def context(df: DataFrame, by: str, texts: list[str], negative: list[str], positive: list[str]) -> DataFrame:
    """(by, negative, positive): how many different phrases of the two lexicons, folded words of the caller's, stand in the
    texts of a document. A phrase counts wherever its letters stand, in longer words too."""
    t = df.select(by, X.once(X.rule_text(F.concat_ws("\n", *[F.col(c) for c in texts]))).alias("__t"))
    bits: list[Column] = []

    def found(lexicon: list[str]) -> Column:
        listed, total = list(dict.fromkeys(lexicon)), F.lit(0)
        for at in range(0, len(listed), 60):
            mask = F.lit(0).cast("long")
            for i, p in enumerate(listed[at : at + 60]):
                mask = mask.bitwiseOR(F.when(F.contains(F.col("__t"), F.lit(p)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
            bits.append(F.bit_or(mask).alias(f"__b{len(bits)}"))
            total = total + F.bit_count(F.col(f"__b{len(bits) - 1}"))
        return total

    n, p = found(negative), found(positive)
    g = t.groupBy(by).agg(*bits) if bits else t.select(by).distinct()
    return g.select(by, n.alias("negative"), p.alias("positive"))


def specific(match_type: Column, score: Column, overlap: Column, coverage: Column, words: Column, anchors: list[str]) -> Column:
    """Does a link speak for one product? By an exact kind of match, by a strong score over shared words, or by two of the
    caller's ``anchors`` among its folded words."""
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(a) for a in anchors]).cast("array<string>")))
    return F.coalesce(high_trust(match_type) | ((score >= 94) & (overlap >= 2) & (coverage >= 0.5)) | ((hits >= 2) & (score >= 88)), F.lit(False))


def token_pool(linked: DataFrame, by: str, words: str) -> DataFrame:
    """(by, pool): all folded words of a document's matched candidates."""
    return linked.select(by, F.explode(words).alias("w")).distinct().groupBy(by).agg(F.collect_set("w").alias("pool"))


def leftovers(linked: DataFrame, by: str) -> DataFrame:
    """``linked`` with ``place``: matched candidates by gate score, strength, score and margin, then the others, ties by ``seq``."""
    w = Window.partitionBy(by).orderBy(F.desc("matched"), F.desc_nulls_last("gate_score"), F.desc("is_strong"), F.desc("score"), F.desc("margin"), "seq")
    return linked.withColumn("place", F.row_number().over(w))


def evidence(linked: DataFrame, by: str, entry: str = "entry_id") -> DataFrame:
    """(by, entry, gate_score, match_score, margin, match_type, is_strong, specific, support, n_sources, first_line): one row an
    entry of a document. The attributes are those of the best candidate, ties going to the first ``seq``."""
    best = F.max_by(F.struct("match_score", "margin", "match_type", "is_strong", "specific"), F.struct("gate_score", (-F.col("seq")).alias("s")))
    e = linked.groupBy(by, entry).agg(F.max("gate_score").alias("gate_score"), best.alias("b"), F.count("*").alias("support"), F.count_distinct("source").alias("n_sources"), F.min("line_index").alias("first_line"))
    return e.select(by, entry, "gate_score", "b.*", "support", "n_sources", "first_line")


def qualifies(cfg: GateConfig = GateConfig()) -> Column:
    """Is an entry's evidence good enough?"""
    trust, strong = high_trust(F.col("match_type")), F.col("is_strong")
    return (
        (F.col("match_score") >= cfg.least_match)
        & (trust | (F.col("margin") >= cfg.least_margin))
        & (strong | (F.col("margin") >= cfg.weak_margin))
        & (F.col("gate_score") >= F.when(strong, cfg.strong_bar).otherwise(cfg.weak_bar))
    )


def drop_subsets(df: DataFrame, by: str, words: str, order: list[str]) -> DataFrame:
    """Rows whose word set isn't contained in that of a row of the same group that comes before it in ``order``
    (descending). A group is the entries of one document; since containment is transitive, being inside any earlier
    set is the same as being inside a kept one."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(words).over(w)
    return df.withColumn("__e", earlier).where(~F.exists("__e", lambda x: F.size(F.array_except(F.col(words), x)) == 0)).drop("__e")


def choose(e: DataFrame, by: str, pool: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(by, mode, chosen, gate_score, match_type, margin, specific): the entries that a document names, the rest from the first
    of them. ``e`` is the evidence with ``words``, ``item_count`` and ``prior`` of each entry.

    An entry of several items wins if it qualifies, or if its match is good, the pool covers its words and two exactly
    matched qualified entries are parts of it: by coverage, words, score, then id. Else two or more qualified single
    entries, none inside another, are composed, the first ``most_items`` by line. Else the best qualified one."""
    trust, size = high_trust(F.col("match_type")), F.size("words")
    q = e.withColumn("ok", F.coalesce(qualifies(cfg), F.lit(False))).withColumn("trust", trust).withColumn("n", size)
    full = q.where("item_count > 1 and n > 0").join(pool, by, "left").withColumn("cov", F.size(F.array_intersect("words", F.coalesce("pool", F.array().cast("array<string>")))) / F.col("n"))
    parts = q.where("ok and trust and n > 0").select(by, F.col("entry_id").alias("part"), F.col("words").alias("part_words"))
    inside = (F.col("part") != F.col("entry_id")) & (F.size(F.array_except("part_words", "words")) == 0)
    held = full.select(by, "entry_id", "words").join(parts, by).where(inside).groupBy(by, "entry_id").agg(F.count("*").alias("parts"))
    full = full.join(held, [by, "entry_id"], "left").where(F.col("ok") | ((F.col("match_score") >= cfg.least_match) & (F.col("cov") >= cfg.coverage) & (F.col("parts") >= cfg.least_parts)))
    first = lambda df, order: df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    full = first(full, [F.desc("cov"), F.desc("n"), F.desc("match_score"), F.desc("entry_id")]).where("r = 1").select("*", F.lit(1).alias("tier"))
    order = ["n", "prior", "gate_score", "entry_id"]
    atoms = drop_subsets(q.where("ok and item_count <= 1"), by, "words", order)
    several = atoms.groupBy(by).agg(F.count("*").alias("k")).where("k > 1").select(by)
    multi = first(atoms.join(several, by), [F.asc_nulls_last("first_line"), F.desc("gate_score"), F.asc("entry_id")]).where(F.col("r") <= cfg.most_items).select("*", F.lit(2).alias("tier"))
    single = first(drop_subsets(q.where("ok"), by, "words", order), [F.desc("trust"), F.desc("gate_score"), F.desc("match_score"), F.desc("prior"), F.desc("entry_id")]).where("r = 1").select("*", F.lit(3).alias("tier"))
    fields = [by, "tier", "r", "entry_id", "gate_score", "match_type", "margin", "specific"]
    rows = full.select(fields).unionByName(multi.select(fields)).unionByName(single.select(fields))
    best = rows.groupBy(by).agg(F.min("tier").alias("best"))
    rows = rows.join(best, by).where("tier = best").groupBy(by, "tier").agg(F.array_sort(F.collect_list(F.struct("r", "entry_id", "gate_score", "match_type", "margin", "specific"))).alias("x"))  # at most ``most_items``
    mode = F.when(F.col("tier") == 1, "full").when(F.col("tier") == 2, "multi").otherwise("single")
    head = F.col("x")[0]
    return rows.select(by, mode.alias("mode"), F.transform("x", lambda x: x["entry_id"]).alias("chosen"), F.array_min(F.transform("x", lambda x: x["gate_score"])).alias("gate_score"), head["match_type"].alias("match_type"), head["margin"].alias("margin"), F.exists("x", lambda x: x["specific"]).alias("specific"))


def ambiguous(e: DataFrame, by: str, words: str, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(by, n_close): for each document, rivals of its best entry within ``ambiguous_gap`` whose words aren't nested."""
    w = Window.partitionBy(by).orderBy(F.desc("gate_score"), F.desc("match_score"), "entry_id")
    r = e.withColumn("r", F.row_number().over(w)).withColumn("best", F.first("gate_score").over(w)).withColumn("bw", F.first(words).over(w))
    nested = (F.size(F.array_except(F.col(words), F.col("bw"))) == 0) | (F.size(F.array_except(F.col("bw"), F.col(words))) == 0)
    close = (F.col("r") > 1) & (F.col("best") - F.col("gate_score") <= cfg.ambiguous_gap) & ~nested
    return r.groupBy(by).agg(F.sum(close.cast("long")).alias("n_close"))


def decide(docs: DataFrame, chosen: DataFrame, rules: DataFrame, by: str, contexts: DataFrame | None = None, generic: DataFrame | None = None, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(by, emit, reason, chosen, gate_score): one row for every document of ``docs``.

    A rule's hit (``rules``: by, canonical, priority, the best of each document) of ``rule_override`` emits its name, which
    also rescues documents without candidates. Else what was chosen is emitted, unless the context (by, negative) speaks
    against it: many negative phrases without specific evidence, some with a partial match of low margin, or a ``generic``
    text (by) with no more than a partial match and no strong rule. ``chosen`` are ids or names."""
    d = docs.select(by).distinct().join(rules.select(by, F.col("canonical").alias("__rule"), F.col("priority").alias("__priority")), by, "left").join(chosen, by, "left")
    d = d.join(contexts.select(by, "negative"), by, "left") if contexts is not None else d.withColumn("negative", F.lit(0))
    d = d.join(generic.select(by, F.lit(True).alias("__generic")).distinct(), by, "left") if generic is not None else d.withColumn("__generic", F.lit(False))
    override = F.col("__priority") >= cfg.rule_override
    partial = F.coalesce(F.col("match_type").contains("partial"), F.lit(False))
    weak, told = ~F.coalesce("specific", F.lit(False)), F.coalesce("negative", F.lit(0))
    reason = (
        F.when(F.coalesce(override, F.lit(False)), "rule")
        .when(F.col("chosen").isNull(), "no_match")
        .when((told >= cfg.many_negative) & weak, "negative_context")
        .when((told >= cfg.some_negative) & partial & (F.col("margin") < cfg.low_margin), "negative_context_low_margin")
        .when(F.coalesce("__generic", F.lit(False)) & partial & weak & ~F.coalesce(F.col("__priority") >= cfg.rule_strong, F.lit(False)), "generic_topic")
        .otherwise(F.col("mode"))
    )
    d = d.withColumn("reason", reason)
    names = F.when(F.col("reason") == "rule", F.array("__rule")).when(F.col("reason").isin("full", "multi", "single"), F.col("chosen")).otherwise(F.array().cast("array<string>"))
    return d.select(by, (F.size(names) > 0).alias("emit"), "reason", names.alias("chosen"), F.when(F.col("reason") == "rule", 1.0).otherwise(F.col("gate_score")).alias("gate_score"))


def rescued(texts: DataFrame, decisions: DataFrame, rules: DataFrame, by: str, cfg: GateConfig = GateConfig()) -> DataFrame:
    """(by, canonical): documents of ``texts`` without a decision that a strong enough rule names."""
    return texts.select(by).distinct().join(decisions.select(by), by, "left_anti").join(rules.where(F.col("priority") >= cfg.rule_override).select(by, "canonical"), by)
