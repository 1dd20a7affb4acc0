"""Evaluation texts leaking into documents.

Each window of words is embedded by a CGK random walk: a pointer runs over the window, writes the word it stands on at
every step and moves on by a bit drawn from that word and the step, so that texts at a small edit distance write much
the same string. A few sampled steps of that string are a bucket, and every bucket shared with an item's window is
verified exactly.

``find_leaks`` takes windows of 12 equal words, edit distance 0, for which one bucket finds all. ``near_leaks`` takes
windows of the items' own sizes and finds items with a few words changed, left out or put in; it repeats the sampling
until the wanted share of them shares a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tramloom.llm.codes import Codes, Words, fold_table, mixed, pieces

STEP = 1 << 19
FILTER_BITS = 22


@dataclass(frozen=True)
class LeakConfig:
    """``words``: length of a window; ``sampled``: steps of the walk in its bucket; ``max_items``: items that a task may
    hold."""

    words: int = 12
    sampled: int = 8
    max_items: int = 20_000
    seed: int = 7


@dataclass(frozen=True)
class NearConfig:
    """``max_edits``: word edits allowed, but for short items a fifth of their words at most; ``walks``: random walks;
    ``tables``: buckets sampled from each; ``sampled``: steps of the walk in a bucket. With the defaults at least 0.95 of
    the windows at one edit, and 0.9 of those at three, share a bucket (measured in the tests). ``grid``: an item is cut
    to windows of the largest size of a geometric row that fits, so that few sizes are tried on the documents."""

    max_edits: int = 3
    walks: int = 4
    tables: int = 4
    sampled: int = 3
    grid: float = 1.2
    max_items: int = 20_000
    seed: int = 7

    def allowed(self, n: int | np.ndarray) -> int | np.ndarray:
        return np.minimum(self.max_edits, n // 5)

    def size(self, n: int) -> int:
        """Size of the windows of an item of ``n`` words."""
        i = int(math.log(n, self.grid)) + 1
        while math.floor(self.grid**i) > n:
            i -= 1
        return max(1, math.floor(self.grid**i))

    def plan(self, size: int) -> list[tuple[int, list[np.ndarray]]]:
        """(walk, sampled steps of each of its buckets). Steps are drawn from those that a walk takes inside most of the
        window; every walk has its own bits, since one that strays far after an edit fails in all its buckets."""
        draw = np.random.default_rng([self.seed, size])
        steps = max(self.sampled, math.ceil(1.5 * size))
        return [(int(draw.integers(1 << 62)), [np.sort(draw.choice(steps, self.sampled, replace=False)) for _ in range(self.tables)]) for _ in range(self.walks)]


def starts_of(words: Words, n: int) -> np.ndarray:
    """First words of the windows of ``n`` words within one text."""
    if len(words.doc) < n:
        return np.empty(0, np.int64)
    return np.flatnonzero(words.doc[: len(words.doc) - n + 1] == words.doc[n - 1 :])


def buckets(hashes: np.ndarray, start: np.ndarray, words: int, walk: int, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Bucket of each window in each table of one walk."""
    bits = mixed(hashes ^ np.uint64(walk))
    at, end = start.copy(), start + words
    out = [np.zeros(len(start), np.uint64) for _ in tables]
    last = len(hashes) - 1
    for j in range(max(int(t.max()) for t in tables) + 1):
        word = np.minimum(at, last)
        held = [o for o, t in zip(range(len(out)), tables) if j in t]
        if held:
            letter = np.where(at < end, hashes[word], np.uint64(1))
            for o in held:
                out[o] = out[o] * np.uint64(0x9E3779B97F4A7C15) + letter
        at += ((bits[word] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return [mixed(o) for o in out]


class Table:
    """Items' windows by bucket."""

    def __init__(self, sig: np.ndarray, start: np.ndarray):
        order = np.argsort(sig, kind="stable")
        self.sig, self.start = sig[order], start[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(sig >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def pairs(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a window, start of an item's window) of equal bucket."""
        near = np.flatnonzero(self.seen[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.sig, own[near], "left"), np.searchsorted(self.sig, own[near], "right")
        count = hi - lo
        return np.repeat(near, count), self.start[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]


class Items:
    """Words of the items, and tables of their windows: of 12 words for exact runs, by size for near ones."""

    def __init__(self, ids: list[int], texts: list[str | None], cfg: LeakConfig | NearConfig):
        self.ids = np.array(ids, np.int64)
        self.words = words = Words(Codes(pa.array(texts, pa.string())), fold_table())
        self.count = np.diff(words.first)
        self.tables: list[tuple[int, int, list[np.ndarray], list[Table]]] = []
        if isinstance(cfg, LeakConfig):
            steps = np.sort(np.random.default_rng(cfg.seed).choice(3 * cfg.words, cfg.sampled, replace=False))
            self._add(cfg.words, cfg.seed, [steps], starts_of(words, cfg.words))
            return
        size = np.array([cfg.size(n) if n else 0 for n in self.count.tolist()], np.int64)
        for w in np.unique(size[size > 0]).tolist():
            start = starts_of(words, w)
            start = start[size[words.doc[start]] == w]
            for walk, tables in cfg.plan(w):
                self._add(w, walk, tables, start)
        self.vocabulary = np.unique(words.hash)

    def _add(self, size: int, walk: int, steps: list[np.ndarray], start: np.ndarray) -> None:
        if len(start):
            self.tables.append((size, walk, steps, [Table(sig, start) for sig in buckets(self.words.hash, start, size, walk, steps)]))


def leaks(texts: pa.Array, items: Items, cfg: LeakConfig) -> np.ndarray:
    """Pairs (text, item) of the batch that share a window of equal words, as rows of an array."""
    words = Words(Codes(texts), fold_table())
    starts = starts_of(words, cfg.words)
    found = [np.empty(0, np.int64)]
    n_items = max(1, len(items.ids))
    for a in range(0, len(starts), STEP):
        start = starts[a : a + STEP]
        for size, walk, steps, tables in items.tables:
            w, y = tables[0].pairs(buckets(words.hash, start, size, walk, steps)[0])
            x = start[w]
            same = np.ones(len(x), bool)
            for j in range(size):
                same &= words.hash[x + j] == items.words.hash[y + j]
            found.append(np.unique(words.doc[x[same]].astype(np.int64) * n_items + items.words.doc[y[same]]))
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // n_items, pairs % n_items], axis=1)


def edits_at(words: Words, items: Words, doc: np.ndarray, at: np.ndarray, item: np.ndarray, drift: int) -> np.ndarray:
    """Fewest word edits between each item and a stretch of its document that begins within ``drift`` words of ``at``, for
    all pairs at once, over the band of alignments that stray by so much."""
    wide, n = 2 * drift + 1, np.diff(items.first)[item]
    last_word, last_item = max(0, len(words.hash) - 1), max(0, len(items.hash) - 1)
    cost = np.zeros((wide, len(at)), np.int16)
    best = np.full(len(at), 1 << 14, np.int16)
    best[n == 0] = 0
    for i in range(int(n.max(initial=0))):
        mine = items.hash[np.minimum(items.first[item] + i, last_item)]
        new = np.empty_like(cost)
        for d in range(wide):
            x = at + i + d - drift
            inside = (x >= words.first[doc]) & (x < words.first[doc + 1])
            differ = ~(inside & (words.hash[np.clip(x, 0, last_word)] == mine))
            step = cost[d] + differ
            if d + 1 < wide:
                step = np.minimum(step, cost[d + 1] + 1)
            if d:
                step = np.minimum(step, new[d - 1] + 1)
            new[d] = step
        cost = new
        best = np.where(n == i + 1, cost.min(0), best)
    return best


def near(texts: pa.Array, items: Items, cfg: NearConfig) -> np.ndarray:
    """(text, item, edits) of the batch: items that stand in a text within their allowed edits, as rows of an array."""
    words = Words(Codes(texts), fold_table())
    n_items = max(1, len(items.ids))
    out = [np.empty((0, 3), np.int64)]
    if not len(words.hash) or not items.tables:
        return out[0]
    place = np.minimum(np.searchsorted(items.vocabulary, words.hash), len(items.vocabulary) - 1)
    listed = np.concatenate([[0], np.cumsum(items.vocabulary[place] == words.hash)])
    size_before, starts = 0, np.empty(0, np.int64)
    for size, walk, steps, tables in items.tables:
        if size != size_before:
            size_before, starts = size, starts_of(words, size)
            # a window within k edits of an item's has all but k of its words from the items
            starts = starts[listed[starts + size] - listed[starts] >= size - int(cfg.allowed(math.ceil(size * cfg.grid) + 1))]
        for a in range(0, len(starts), STEP):
            start = starts[a : a + STEP]
            for own, table in zip(buckets(words.hash, start, size, walk, steps), tables):
                w, y = table.pairs(own)
                item = items.words.doc[y].astype(np.int64)
                at = start[w] - (y - items.words.first[item])
                key = np.unique(np.stack([words.doc[start[w]].astype(np.int64), at, item], 1), axis=0)
                e = edits_at(words, items.words, key[:, 0], key[:, 1], key[:, 2], 2 * cfg.max_edits)
                ok = e <= cfg.allowed(items.count[key[:, 2]])
                out.append(np.stack([key[ok, 0], key[ok, 2], e[ok].astype(np.int64)], 1))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0] * n_items + rows[:, 1]))]
    pair = rows[:, 0] * n_items + rows[:, 1]
    return rows[np.append(True, pair[1:] != pair[:-1])] if len(rows) else rows


def find_leaks(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id): one row per document and item that share a window of ``cfg.words`` equal words. Case, accents,
    punctuation, blanks and characters of no width don't count.

    Documents are read once and nothing is shuffled. The items are a query set: they travel to the tasks in blocks of
    at most ``cfg.max_items``, their number being checked first.

    Defined results: NULL and blank texts and texts of fewer words share nothing; items of equal text are all named;
    very long documents are read whole; repeated rows give repeated pairs; other columns don't matter.
    """
    return _in_blocks(docs, items, cfg, leaks, [])


def near_leaks(docs: DataFrame, items: DataFrame, cfg: NearConfig = NearConfig()) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold an item with at most its allowed word edits, and the fewest found.

    Laid out like ``find_leaks``, with the same defined results; an item of fewer than five words must stand as it is, one
    without words is nowhere. What shares no bucket is missed, by the recall that the configuration states.
    """
    return _in_blocks(docs, items, cfg, near, [T.StructField("edits", T.IntegerType())])


def _in_blocks(docs: DataFrame, items: DataFrame, cfg: LeakConfig | NearConfig, find: Callable, more: list[T.StructField]) -> DataFrame:
    listed = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    blocks = max(1, math.ceil(listed.count() / cfg.max_items))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), *more])
    out = None
    for b in range(blocks):
        rows = (listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).collect()
        held = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = Items(*held.value, cfg)
            for batch in pieces(batches):
                found = find(batch.column(1), own, cfg)
                if len(found):
                    cells = [batch.column(0).take(pa.array(found[:, 0])), pa.array(own.ids[found[:, 1]]), *(pa.array(found[:, 2].astype(np.int32)) for _ in more)]
                    yield pa.RecordBatch.from_arrays(cells, names=schema.names)

        part = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
