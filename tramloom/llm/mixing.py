"""Mixing sources to target weights.

Points of the golden-ratio sequence fall on the cumulated target shares, so that every stretch of slots holds nearly
the wanted share of each source. A slot's rank among those of its source is its block: each source's documents are
shuffled and laid end to end into blocks of equal tokens, and slot r of a source takes its block r. A source short of
tokens starts over, at most ``max_repeats`` times.

How many of the first n points fall on a stretch is known exactly without drawing them (a floor sum), so the plan is
that of the schedule, and ranks need no shuffle. Running sums of tokens are taken in two levels, so that no task holds
a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tramloom.llm.tokens import with_tokens
from tramloom.sources.tables import written

#: Slot n stands at (n * GOLDEN mod RING) / RING, with the golden ratio's fraction as an integer, so without rounding.
RING = 1 << 62
GOLDEN = (math.isqrt(5 * RING * RING) - RING) // 2
MAX_TARGETS = 100_000
#: Documents in one part of a source's running sum.
PART = 100_000


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of (a * i + b) // m for i below n, by the steps of Euclid's algorithm."""
    total = 0
    while n > 0:
        total += (a // m) * (n * (n - 1) // 2) + (b // m) * n
        a, b = a % m, b % m
        last = a * n + b
        n, b = divmod(last, m)
        m, a = a, m
    return total


def points_on(n: int, low: int, high: int) -> int:
    """How many of the first ``n`` points lie from ``low`` to below ``high``."""
    return floor_sum(n, RING, GOLDEN, -low) - floor_sum(n, RING, GOLDEN, -high)


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, ``_`` between words."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")


def targets(mix: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats) with one row a source; shares that aren't positive count as 0."""
    return (
        mix.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    )


PLAN = "source string, target_share double, share double, max_repeats long, n_docs long, tokens long, slots long, blocks long, low long, high long"


def plan(tokens: DataFrame, mix: DataFrame, total_tokens: int | None = None, block: int = 512) -> DataFrame:
    """(source, target_share, share, max_repeats, n_docs, tokens, slots, blocks, low, high): the schedule's number of slots
    and of each source's blocks in them, and its stretch of the points.

    ``share`` is the target among the sources that have tokens, scaled to add up to one. Without ``total_tokens`` the
    schedule ends before the first slot whose source has used up its repeats. With it, it has as many slots as the total
    needs, and those of a used-up source stay empty. One row a target; sources without tokens give nothing, documents
    without a target aren't used.
    """
    if mix.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    have = tokens.where("tokens > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    rows = sorted(targets(mix).join(have, "source", "left").fillna(0, ["n_docs", "tokens"]).collect())  # a row a target
    weights = [r.target_share if r.tokens and r.max_repeats else 0.0 for r in rows]
    whole = sum(weights)
    ends = [int(x / whole * RING) if whole else 0 for x in np.cumsum(weights)]
    if whole:
        last = max(i for i, w in enumerate(weights) if w)
        ends[last:] = [RING] * (len(ends) - last)
    stretches = list(zip([0, *ends[:-1]], ends))
    most = [-(-r.tokens * r.max_repeats // block) for r in rows]
    counts = lambda n: [points_on(n, a, b) for a, b in stretches]
    if not whole:
        slots = 0
    elif total_tokens is not None:
        slots = -(-total_tokens // block)
    else:
        slots, over = 0, sum(most) + 1  # the largest number of slots that no source is short of
        while over - slots > 1:
            half = (slots + over) // 2
            fits = all(c <= m for c, m in zip(counts(half), most))
            slots, over = (half, over) if fits else (slots, half)
    blocks = [min(c, m) for c, m in zip(counts(slots), most)] if slots else [0] * len(rows)
    out = [(r.source, r.target_share, w / whole if whole else 0.0, r.max_repeats, r.n_docs, r.tokens, slots, n, a, b) for r, w, n, (a, b) in zip(rows, weights, blocks, stretches)]
    return tokens.sparkSession.createDataFrame(out, PLAN)


def repeats(tokens: DataFrame, planned: DataFrame, block: int = 512, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, at, repeats): where each document starts in its source's shuffled row of tokens and how
    often it is used; documents that aren't used have 0. A use counts if it begins in one of the source's blocks; the one
    that the last block cuts is used whole, so that a source exceeds its blocks by less than one document."""
    t = F.broadcast(planned.where("blocks > 0").select("source", F.col("tokens").alias("all"), (F.col("blocks") * block).alias("budget"), "max_repeats", F.greatest(F.lit(16), F.ceil(F.col("n_docs") / PART)).alias("parts")))  # a row a target
    named = tokens.where("tokens > 0").select("doc_id", source_name(F.col("source")).alias("source"), "tokens").join(t, "source")
    laid = named.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod(F.shiftrightunsigned("key", 20), F.col("parts")))
    sums = laid.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sums.select("source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    laid = laid.join(starts, ["source", "part"]).withColumn("at", at.cast("long"))
    used = F.least(F.greatest(F.ceil((F.col("budget") - F.col("at")) / F.col("all")), F.lit(0)), F.col("max_repeats"))
    return laid.select("doc_id", "source", "tokens", "at", used.cast("long").alias("repeats"))


def shares(tokens: DataFrame, mix: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, actual_share, n_docs, used_docs, used_tokens, most_repeats): the outcome by source."""
    planned = plan(tokens, mix, total_tokens)
    used = repeats(tokens, planned).where("repeats > 0").groupBy("source").agg(F.count("*").alias("used_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    out = planned.join(used, "source", "left").fillna(0, ["used_docs", "used_tokens", "most_repeats"])
    actual = F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(Window.partitionBy()), F.lit(1))
    return out.select("source", "target_share", F.round("share", 6).alias("share"), F.round(actual, 6).alias("actual_share"), "n_docs", "used_docs", "used_tokens", "most_repeats")


def slot_table(planned: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(slot, source, block) of every slot; ``block`` is NULL where the source is used up. Each chunk of slots is made by
    itself: the ranks before it are a floor sum, those inside it a count."""
    rows = planned.where("high > low").orderBy("low").collect()  # a row a target
    spark = planned.sparkSession
    slots = rows[0].slots if rows else 0
    names, ends, low, blocks = [r.source for r in rows], np.array([r.high for r in rows], np.uint64), [r.low for r in rows], np.array([r.blocks for r in rows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                slot = np.arange(c * chunk, min(slots, (c + 1) * chunk), dtype=np.int64)
                at = np.searchsorted(ends, (slot.astype(np.uint64) * np.uint64(GOLDEN)) & np.uint64(RING - 1), "right")
                first = np.array([points_on(c * chunk, a, int(e)) for a, e in zip(low, ends)], np.int64)
                order = np.argsort(at, kind="stable")
                run_start = np.searchsorted(at[order], np.arange(len(names)))
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - run_start[at[order]]
                rank += first[at]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(names, pa.string()).take(pa.array(at)), pa.array(rank, mask=rank >= blocks[at])], names=["slot", "source", "block"])

    chunks = -(-slots // chunk)
    tasks = max(1, min(chunks, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, chunks, 1, tasks).mapInArrow(run, "slot long, source string, block long")


def schedule(tokens: DataFrame, mix: DataFrame, total_tokens: int | None = None, block: int = 512) -> DataFrame:
    """(slot, source, block, doc_id, round, first_token, stop_token): for each slot its source, that source's block, and the
    stretches of documents that fill it, a row each. A document is used once for each round; the last block of a source
    runs on to the end of its last document. An empty slot has one row with NULLs. The uses are those of ``repeats``."""
    planned = plan(tokens, mix, total_tokens, block)
    t = F.broadcast(planned.select("source", F.col("tokens").alias("all"), "blocks"))  # a row a target
    use = repeats(tokens, planned, block).where("repeats > 0").join(t, "source")
    copies = use.select("doc_id", "source", "tokens", "blocks", "at", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("round"))
    placed = copies.withColumn("from", F.col("round") * F.col("all") + F.col("at"))
    part = lambda c: F.least(F.expr(f"({c}) div {block}"), F.col("blocks") - 1)
    pieces = placed.select("*", F.explode(F.sequence(part("from"), part("from + tokens - 1"))).alias("block"))
    begin, end = F.col("block") * block - F.col("from"), (F.col("block") + 1) * block - F.col("from")
    pieces = pieces.select("source", "block", "doc_id", "round", F.greatest(begin, F.lit(0)).alias("first_token"), F.when(F.col("block") == F.col("blocks") - 1, F.col("tokens")).otherwise(F.least(end, F.col("tokens"))).alias("stop_token"))
    return slot_table(planned).join(pieces, ["source", "block"], "left").select("slot", "source", "block", "doc_id", "round", "first_token", "stop_token")


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Tokens of each document; written once, since plan, repeats and schedule all read it."""
    return written(with_tokens(docs, vocabulary))
