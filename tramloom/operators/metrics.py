"""Summaries: error rates, quantiles, top counts, leaderboards, checks of an output table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.functions import text as X


def audit_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median and 90th percentile (exact, interpolated) of ``value`` by group."""
    v = F.col(value)
    q = quantiles(df, by, value, [0.5, 0.9])
    n = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"))
    q = q.withColumnRenamed(by, "__by")
    return n.join(q, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", "mean", F.round("q0", 6).alias("median"), F.round("q1", 6).alias("p90"))


def quantiles(df: DataFrame, by: str, value: str, at: list[float]) -> DataFrame:
    """(by, q0, q1, ..): exact interpolated quantiles of ``value`` by group.

    Equal values of a group are counted first, with a combine before the shuffle. Counts are then summed over as many
    stretches of values as the session has shuffle partitions, and only the stretches that hold a wanted place are
    looked into, so that no task holds a whole group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ends = counts.groupBy(F.col("g").alias("e")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    laid = counts.join(ends, F.col("g").eqNullSafe(F.col("e"))).select("g", "v", "c", "n", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))).otherwise(0).alias("part"))
    sums = laid.groupBy("g", "part").agg(F.sum("c").alias("s"))
    starts = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = [F.lit(q) * (F.col("n") - 1) for q in at]
    wanted = [x for q in places for x in (F.floor(q), F.ceil(q))]
    starts = starts.select(F.col("g").alias("e"), F.col("part").alias("p"), "before", "s")
    near = laid.join(starts, F.col("g").eqNullSafe(F.col("e")) & (F.col("part") == F.col("p")))
    hit = near.where(reduce(lambda x, y: x | y, [(w >= F.col("before")) & (w < F.col("before") + F.col("s")) for w in wanted]))
    first = F.col("before") + F.coalesce(F.sum("c").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = hit.withColumn("first", first)
    pick = lambda w: F.max(F.when((w >= F.col("first")) & (w < F.col("first") + F.col("c")), F.col("v")))
    out = held.groupBy("g", "n").agg(*[pick(f(q)).alias(f"{k}{i}") for i, q in enumerate(places) for k, f in (("a", F.floor), ("b", F.ceil))])
    return out.select(F.col("g").alias(by), *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (q - F.floor(q))).alias(f"q{i}") for i, q in enumerate(places)])


def objective(df: DataFrame, by: str, value: str, failed: Column, over: float, error: Column) -> DataFrame:
    """Leaderboard of configurations: median + 0.5 p90 + 2 share without a reading + 1.5 share above ``over`` + 3 share of
    errors, the least first (``place``), ties by p90, median, then name."""
    v = F.col(value)
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.max(v).alias("worst"), rate(failed).alias("fail_rate"), rate(v > over).alias("over_rate"), rate(error).alias("error_rate"))
    q = quantiles(df, by, value, [0.5, 0.9, 0.95]).select(F.col(by).alias("__by"), F.col("q0").alias("median"), F.col("q1").alias("p90"), F.col("q2").alias("p95"))
    g = g.join(q, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    score = F.col("median") + 0.5 * F.col("p90") + 2 * F.col("fail_rate") + 1.5 * F.col("over_rate") + 3 * F.col("error_rate")
    g = g.withColumn("objective", F.round(score, 6))
    order = Window.orderBy(F.col("objective").asc_nulls_last(), F.col("p90").asc_nulls_last(), F.col("median").asc_nulls_last(), by)  # a row a configuration
    return g.select(by, "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p95", "worst", "fail_rate", "over_rate", "error_rate")], "objective", F.row_number().over(order).alias("place"))


def worst_first(df: DataFrame, value: str, key: str, top: int) -> DataFrame:
    """The ``top`` rows with the largest ``value``, NULL last, ties by key: a report."""
    return df.orderBy(F.col(value).desc_nulls_last(), key).limit(top)


def rates(df: DataFrame, flags: dict[str, Column], numbers: list[str], ids: str | None = None) -> DataFrame:
    """One row: ``n``, ``n_ids``, count and rate of each flag, mean and median of each number."""
    n = F.count("*")
    out = [n.alias("n")] + ([F.count_distinct(ids).alias("n_ids")] if ids else [])
    for k, c in flags.items():
        hits = F.sum(F.coalesce(c, F.lit(False)).cast("long"))
        out += [F.coalesce(hits, F.lit(0)).alias(k), F.round(F.coalesce(hits, F.lit(0)) / F.greatest(n, F.lit(1)), 6).alias(f"{k}_rate")]
    whole = df.agg(*out, *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in numbers])
    for c in numbers:
        m = quantiles(df.select(F.lit(1).alias("one"), c), "one", c, [0.5]).select(F.round("q0", 6).alias(f"median_{c}"))
        whole = whole.join(m, F.lit(True), "left")  # one row on either side
    return whole


def linking_summary(links: DataFrame, image: str = "image_id") -> DataFrame:
    """One row over linked candidates: rows, images, matched and strong counts and rates, mean and median score and margin."""
    return rates(links, {"matched": F.col("matched"), "strong": F.col("is_strong")}, ["score", "margin"], image)


def gating_summary(decisions: DataFrame) -> DataFrame:
    """One row over decisions: rows, emitted count and rate, mean and median gate score of those emitted."""
    return rates(decisions.withColumn("gate_score", F.when(F.col("emit"), F.col("gate_score"))), {"emitted": F.col("emit")}, ["gate_score"])


def audit_rows(readings: DataFrame, labels: DataFrame, by: str = "image_id") -> DataFrame:
    """(by, variant, cer, cer_lower, oracle): error rates of each variant's reading against the label, and whether the
    variant is the image's best, ties going to the first name. Images without a label are left out."""
    j = readings.join(labels.select(by, F.col("ocr_text").alias("truth")), by)
    j = j.withColumn("cer", F.round(X.cer(F.col("text"), F.col("truth")), 6)).withColumn("cer_lower", F.round(X.cer(F.col("text"), F.col("truth"), lower=True), 6))
    best = j.groupBy(by).agg(F.min_by("variant", F.struct("cer", "variant")).alias("__best"))
    return j.join(best, by).select(by, "variant", "cer", "cer_lower", (F.col("variant") == F.col("__best")).alias("oracle"))


def tuning_sample(audit: DataFrame, labels: DataFrame, n: int, cer: tuple[float, float] = (0.0, 1.5), boxes: tuple[int, int] = (1, 29), most_chars: int = 499, mode: str = "head", seed: int = 42) -> DataFrame:
    """(tune_idx, image_id, truth): audited images without an error within the bounds, with their label's text, ``n`` from
    the head, the tail or at random, numbered from 1: a sampling operator."""
    kept = audit.where((F.coalesce(F.trim("error"), F.lit("")) == "") & F.col("cer").between(*cer) & F.col("boxes").between(*boxes) & (F.length(F.coalesce("text", F.lit(""))) <= most_chars))
    j = kept.select("image_id").distinct().join(labels.groupBy("image_id").agg(F.min("ocr_text").alias("truth")), "image_id", "left")
    by = {"head": F.asc("image_id"), "tail": F.desc("image_id"), "random": F.asc(F.xxhash64("image_id", F.lit(seed)))}[mode]
    return j.orderBy(by).limit(n).withColumn("tune_idx", F.row_number().over(Window.orderBy("image_id"))).select("tune_idx", "image_id", "truth")


def top_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The ``top`` commonest values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(top)


def oracle_variant(df: DataFrame, by: str, variant: str, value: str) -> DataFrame:
    """(by, variant, value): the variant with the least error of each group; ties go to the first name."""
    best = F.min_by(F.struct(variant, value), F.struct(value, variant))
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(best.alias("b")).select(by, "b.*")


def validate(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows, duplicate keys, and blank values and fill rate of each column, in one pass."""
    n = F.count("*")
    out = [n.alias("n_rows"), (n - F.count_distinct(key)).alias("duplicate_keys")]
    for c in columns:
        blank = F.sum(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", 1).otherwise(0))
        out += [blank.alias(f"blank_{c}"), F.round(1 - blank / F.greatest(n, F.lit(1)), 6).alias(f"fill_{c}")]
    return df.agg(*out)


def f1(predicted: DataFrame, truth: DataFrame, key: str, name: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of exact names by key; blank names count as none."""
    p = predicted.select(key, F.trim(F.col(name)).alias("p")).where("p <> ''")
    t = truth.select(key, F.trim(F.col(name)).alias("t")).where("t <> ''")
    j = p.join(t, key, "full")
    hit = F.coalesce(F.col("p") == F.col("t"), F.lit(False))
    a = j.agg(F.sum(hit.cast("long")).alias("tp"), F.sum((F.col("p").isNotNull() & ~hit).cast("long")).alias("fp"), F.sum((F.col("t").isNotNull() & ~hit).cast("long")).alias("fn")).fillna(0)
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return a.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6).alias("f1"))
