"""Free-entered values mapped to a canonical list.

Distinct values are normalised; candidates come from an inverted index of character trigrams and are all forms whose
weighted cosine reaches the threshold. Of each candidate, every part (brand, kind, variety) must stand in the text
within a few edits and nothing else may be left; the best entry must be ahead of the next one by a margin.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tramloom.functions.workers import per_worker
from tramloom.llm import confusables
from tramloom.llm.codes import Codes, look_table
from tramloom.sources.tables import written

UNMATCHED = "unmatched"

#: Words of packs and sales that are no part of a name, folded; markers before a variety; digits read for letters.
SALES = ["xa kho", "gia soc", "moi", "dac biet", "chinh hang", "new", "combo", "hang viet", "khuyen mai", "sale", "hot", "freeship", "hang moi", "giam gia", "uu dai", "loai"]
UNITS = "ml|lit|l|kg|g|gr|gram|mg|cai|goi|chai|hop|loc|tui|vi|thung|hu|lon|vien|mieng|bich|cay|in1"
PACKS = "hop|loc|chai|tui|vi|goi|thung|hu|lon|bich|cay"
MARKERS = ("", "vi", "huong")
MOST_LEFT = 3
DIGIT_LETTERS = str.maketrans("01345689", "oieasbbg")

PACK_SIZE = re.compile(rf"(?:^| )(?:(?:{PACKS}) )?\d+(?:[ x]\d+)*(?: ?(?:{UNITS}))?(?: (?:goi|cai|hop|chai|tui))?(?= |$)")
SALE = re.compile(r"^(?:(?:" + "|".join(sorted(SALES, key=len, reverse=True)) + r")(?: \d+)?(?: |$))+|(?: (?:" + "|".join(sorted(SALES, key=len, reverse=True)) + r"))+$")
ALNUM = re.compile(r"(?<![a-z0-9])(?=[a-z0-9]*[a-z])[a-z0-9]+")
TELEX = [("dd", "d"), ("aa", "a"), ("aw", "a"), ("ee", "e"), ("oo", "o"), ("uow", "uo"), ("uwow", "uo"), ("ow", "o"), ("uw", "u"), ("w", "u")]
TELEX_TONE = re.compile(r"(?<=[aeiouy])([bcdghkmnpt]*)[sfrxj](?![aeiouy])")


@dataclass(frozen=True)
class MatchConfig:
    """``threshold``: least weighted cosine of a retrieved form; ``margin``: least lead over another entry, in edits less
    cosine; ``max_entries``: entries that a task may hold as an index; ``most_entries``: length up to which a list counts
    as one."""

    threshold: float = 0.30
    margin: float = 0.02
    max_entries: int = 50_000
    most_entries: int = 2_000_000


def fold_values(texts: pa.Array) -> list[str]:
    """Folded words of each text with single blanks: look-alikes as Latin, no accents, lower case."""
    codes = Codes(texts)
    letters = look_table()[codes.cp]
    ends = np.zeros(len(letters) + 1, np.int64)
    np.cumsum(letters != 0, out=ends[1:])
    flat = letters[letters != 0].astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [" ".join(flat[ends[a] : ends[b]].split()) for a, b in zip(codes.start, codes.stop)]


def untelex(s: str) -> str:
    """Folded form of text typed in Telex keys (``bawps`` for bắp)."""
    for a, b in TELEX:
        s = s.replace(a, b)
    return TELEX_TONE.sub(r"\1", s)


def bare(s: str) -> str:
    """``s`` without pack sizes and sales words, digits inside words as letters."""
    s = SALE.sub("", PACK_SIZE.sub(" ", s).strip()).strip()
    return ALNUM.sub(lambda m: m[0].translate(DIGIT_LETTERS), s).replace("_", " ")


def core(s: str) -> str:
    """``s`` without pack sizes, sales words, doubled words and blanks."""
    return joined(bare(s))


def joined(s: str) -> str:
    """The words of ``s`` without blanks, a word repeated at once counting once."""
    words = s.split()
    return "".join(w for i, w in enumerate(words) if not i or w != words[i - 1])


def split_names(displays: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Brand and variety of each display name, found from how its words recur in the list."""
    marked = {}
    for d in displays:
        w = d.split()
        i = next((i for i in range(2, len(w) - 1) if w[i] in ("huong", "vi")), None)
        if i:
            marked[d] = (" ".join(w[:i]), " ".join(w[i + 1 :]))
    varieties = {v for _, v in marked.values()}
    tails = Counter(" ".join(d.split()[-n:]) for d in displays if d not in marked for n in (1, 2, 3) if len(d.split()) > n + 1)
    rest, variety = {}, {}
    for d in displays:
        w = d.split()
        if d in marked:
            rest[d], variety[d] = marked[d]
            continue
        options = [n for n in (3, 2, 1) if len(w) > n + 1]
        known = [n for n in options if " ".join(w[-n:]) in varieties]
        n = known[0] if known else max(options, key=lambda n: (tails[" ".join(w[-n:])] >= 2, n == 2, n), default=0)
        rest[d], variety[d] = " ".join(w[: len(w) - n]), " ".join(w[len(w) - n :]) if n else ""
    kinds_of: dict[str, set[str]] = {}
    brands_of: dict[str, set[str]] = {}
    for r in set(rest.values()):
        w = r.split()
        for i in range(1, len(w)):
            b, k = " ".join(w[:i]), " ".join(w[i:])
            kinds_of.setdefault(b, set()).add(k)
            brands_of.setdefault(k, set()).add(b)
    brand = {}
    for d in displays:
        w = rest[d].split()
        splits = [(" ".join(w[:i]), " ".join(w[i:])) for i in range(1, len(w))]
        brand[d] = max(splits, key=lambda s: (len(kinds_of[s[0]]) * len(brands_of[s[1]]), len(s[1])))[0] if splits else rest[d]
    return brand, variety


@dataclass
class Listed:
    """The whole list, as every block sees it: (entry, brand, kind, variety) of each form, sorted by entry, and the
    trigrams' weights."""

    forms: list[tuple[str, str, str, str]]
    weight: np.ndarray

    @staticmethod
    def of(entries: list[tuple[str, str, list[str]]]) -> Listed:
        named = []
        for entry_id, display, variants in entries:
            forms = fold_values(pa.array([display, *variants], pa.string()))
            named.append((entry_id, forms[0].replace("_", " "), [f.replace("_", " ") for f in forms]))
        brand, variety = split_names([d for _, d, _ in named])
        rows = {}
        for entry_id, display, forms in sorted(named):
            b, v = brand[display], variety[display]
            for f in forms:
                rest = re.sub(rf"(?:^| )(?:(?:huong|vi) )?{re.escape(v)}(?= |$)", " ", f, count=1) if v else f
                rest = re.sub(rf"(?:^| ){re.escape(b)}(?= |$)", " ", rest, count=1) if b else rest
                rows[entry_id, joined(b), joined(rest), joined(v)] = None
        grams = [np.unique(trigrams("".join(r[1:]))[0]) for r in rows]
        df = np.bincount(np.concatenate([*grams, np.empty(0, np.int64)]).astype(np.int64), minlength=A**3)
        return Listed(list(rows), np.log((len(grams) + 1) / (df + 0.5)).clip(0.05))

    def block(self, entries: list[str]) -> Index:
        wanted = set(entries)
        return Index([f for f in self.forms if f[0] in wanted], self.weight)


class Index:
    """Forms of a block of entries: their parts, and an inverted index of their trigrams."""

    def __init__(self, rows: list[tuple[str, str, str, str]], weight: np.ndarray):
        self.entry_ids = sorted({r[0] for r in rows})
        number = {e: i for i, e in enumerate(self.entry_ids)}
        self.entry = np.array([number[r[0]] for r in rows], np.int32)
        self.parts = [tuple(r[1:]) for r in rows]
        self.names = sorted({m + p if k == 2 else p for r in self.parts for k, p in enumerate(r) for m in (MARKERS if k == 2 else ("",))})
        at = {n: i for i, n in enumerate(self.names)}
        # of each form: brand, kind, and the variety after each marker
        self.pattern = np.array([[at[b], at[k], *(at[m + v] for m in MARKERS)] for b, k, v in self.parts], np.int32).reshape(-1, 5)
        self.length = np.array([len(n) for n in self.names], np.int64)
        self.allowed = np.array([edits_allowed(len(n)) for n in self.names])
        # bits of each name's letters, 64 to a word
        self.peq = np.zeros((max(1, -(-int(self.length.max(initial=0)) // 64)), len(self.names), A), np.uint64)
        for i, n in enumerate(self.names):
            for j, c in enumerate(symbol_array(n).tolist()):
                self.peq[j // 64, i, c] |= np.uint64(1 << j % 64)
        grams = [np.unique(trigrams("".join(p))[0]) for p in self.parts]
        self.weight = weight
        flat = np.concatenate([*grams, np.empty(0, np.int64)]).astype(np.int64)
        form = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        order = np.argsort(flat, kind="stable")
        self.post = form[order]
        self.post_at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=A**3))])
        self.longest = max((sum(map(len, p)) for p in self.parts), default=0) + max(map(len, MARKERS)) + MOST_LEFT
        self.norm = np.sqrt(np.bincount(form, weights=self.weight[flat] ** 2, minlength=len(grams))).clip(1e-9)

    def retrieve(self, texts: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, form, cosine) of all forms that reach the threshold, by text.

        The postings of a stretch of texts are added up in an array of texts by forms where they would fill a good part of
        it, else by sorting them."""
        n, forms = len(texts), len(self.parts)
        flat, lengths = trigrams(texts)
        doc = np.repeat(np.arange(n), lengths)
        pairs = np.unique(doc * A**3 + flat) if len(flat) else np.empty(0, np.int64)
        doc, flat = pairs // A**3, pairs % A**3
        norm = np.sqrt(np.bincount(doc, weights=self.weight[flat] ** 2, minlength=n)).clip(1e-9)
        size = self.post_at[flat + 1] - self.post_at[flat]
        total = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=n))])
        out, a = [], 0
        while a < n:
            b = max(a + 1, min(int(np.searchsorted(total, total[a] + 2_000_000, "right")) - 1, n))
            lo, hi = np.searchsorted(doc, [a, b])
            d, g, s = doc[lo:hi] - a, flat[lo:hi], size[lo:hi]
            cell = np.repeat(d, s) * forms + self.post[np.repeat(self.post_at[g] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
            add = np.repeat(self.weight[g] ** 2, s)
            if (b - a) * forms <= 8 * len(cell):
                dots = np.bincount(cell, weights=add, minlength=(b - a) * forms)
                at = np.flatnonzero(dots)
                dots = dots[at]
            else:
                at, which = np.unique(cell, return_inverse=True)
                dots = np.bincount(which, weights=add, minlength=len(at))
            t, f = at // forms + a, at % forms
            cos = dots / (self.norm[f] * norm[t])
            keep = cos >= threshold
            out.append((t[keep], f[keep], cos[keep]))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def edits(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Fewest edits with which each pattern stands anywhere in its text (Myers' bit-parallel search, all pairs at once;
        of names over 64 letters word after word, with what one word hands on to the next)."""
        m = self.length[pattern]
        words = np.maximum(1, -(-m // 64))
        best = np.zeros(len(pattern), np.int64)
        for w in np.unique(words).tolist():
            rows = np.flatnonzero(words == w)
            best[rows] = self._edits(symbols, start[rows], length[rows], pattern[rows], w)
        return best

    def _edits(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, pattern: np.ndarray, words: int) -> np.ndarray:
        m = self.length[pattern]
        one, high = np.uint64(1), np.uint64(63)
        top = one << (np.maximum(m - 1, 0) % 64).astype(np.uint64)
        pv = [np.full(len(pattern), ~np.uint64(0)) for _ in range(words)]
        mv = [np.zeros(len(pattern), np.uint64) for _ in range(words)]
        score, best = m.copy(), m.copy()
        for j in range(int(length.max(initial=0))):
            live = j < length
            letter = symbols[np.minimum(start + j, len(symbols) - 1)]
            up = down = np.uint64(0)  # what the word before hands on
            for w in range(words):
                eq = self.peq[w, pattern, letter]
                xv = eq | mv[w]
                eq = eq | down
                xh = (((eq & pv[w]) + pv[w]) ^ pv[w]) | eq
                ph, mh = mv[w] | ~(xh | pv[w]), pv[w] & xh
                if w == words - 1:
                    score = score + ((ph & top) != 0) - ((mh & top) != 0)
                next_up, next_down = ph >> high, mh >> high
                ph, mh = (ph << one) | up, (mh << one) | down
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                up, down = next_up, next_down
            best = np.where(live, np.minimum(best, score), best)
        return best

    def match(self, texts: list[str], cfg: MatchConfig) -> list[list[tuple[float, str]]]:
        """The two best entries of each core text with their ranks (edits less cosine: lower is closer)."""
        if not self.parts or not texts:
            return [[] for _ in texts]
        fits = [i for i, x in enumerate(texts) if len(x) <= self.longest]  # a longer text has more left over than any form allows
        if len(fits) < len(texts):
            out = [[] for _ in texts]
            for i, e in zip(fits, self.match([texts[i] for i in fits], cfg)):
                out[i] = e
            return out
        t, form, cos = self.retrieve(texts, cfg.threshold)
        lengths = np.array([len(x) for x in texts], np.int64)
        start = np.cumsum(lengths) - lengths
        symbols = symbol_array("".join(texts))
        if not len(symbols):
            return [[] for _ in texts]

        def found(rows: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
            p = self.pattern[form[rows], column]
            e = self.edits(symbols, start[t[rows]], lengths[t[rows]], p)
            return e, p

        cost = np.full(len(t), 99, np.int64)
        rows = np.arange(len(t))
        total, covered = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for column in (0, 1):
            e, p = found(rows, column)
            good = e <= self.allowed[p]
            rows, e, p = rows[good], e[good], p[good]
            total[rows] += e
            covered[rows] += self.length[p]
        for column in (2, 3, 4):
            e, p = found(rows, column)
            left = lengths[t[rows]] - covered[rows] - self.length[p]
            sum_ = total[rows] + e
            good = (e <= self.allowed[p]) & (np.abs(left) <= np.minimum(1 + sum_, MOST_LEFT)) & (sum_ <= np.maximum(2, lengths[t[rows]] // 6))
            # letters beyond the parts and letters missing from them weigh as edits
            cost[rows] = np.where(good, np.minimum(cost[rows], 2 * sum_ + np.abs(left)), cost[rows])
        ok = np.flatnonzero(cost < 99)
        rank = cost[ok] / 2 - cos[ok]
        held: dict[int, dict[int, float]] = {}
        for i, f, r in zip(t[ok].tolist(), self.entry[form[ok]].tolist(), rank.tolist()):
            d = held.setdefault(i, {})
            d[f] = min(r, d.get(f, 1e9))
        out = [[] for _ in texts]
        for i, d in held.items():
            out[i] = sorted((round(r, 9), self.entry_ids[e]) for e, r in d.items())[:2]
        return out


def clear(best: list[tuple[float, str]], margin: float) -> str | None:
    """The best entry if it leads by the margin."""
    best = sorted(best)[:2]
    return best[0][1] if best and (len(best) < 2 or best[1][0] - best[0][0] >= margin) else None


def edits_allowed(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 7 else 2 if n <= 12 else 3


#: Letters that the index tells apart: a to z, 0 to 9, and others in 60 groups.
A = 96


def symbol_array(s: str) -> np.ndarray:
    a = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((a >= 97) & (a <= 122), a - 97, np.where((a >= 48) & (a <= 57), a - 22, 36 + a % 60))


def trigrams(texts: list[str] | str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams of each text, one after another, and how many each has."""
    texts = [texts] if isinstance(texts, str) else texts
    texts = [x if len(x) >= 3 or not x else x + "  "[: 3 - len(x)] for x in texts]  # one or two letters make one
    a = symbol_array("".join(texts))
    lengths = np.array([len(x) for x in texts], np.int64)
    if len(a) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    g = (a[:-2] * A + a[1:-1]) * A + a[2:]
    doc = np.repeat(np.arange(len(texts)), lengths)
    g = g[doc[:-2] == doc[2:]]
    return g, np.maximum(lengths - 2, 0)


def resolve(values: pa.Array, index: Index, cfg: MatchConfig, both: bool = False) -> tuple[list, list]:
    """The best entries of each value as written, and of those not clear (with ``both`` of all) as typed in Telex keys."""
    folded = fold_values(values)
    cores = [core(f) for f in folded]
    todo = sorted(set(cores) - {""})
    found = dict(zip(todo, index.match(todo, cfg)))
    first = [found.get(c, []) for c in cores]
    typed = [core(untelex(bare(f))) if both or clear(x, cfg.margin) is None else c for f, c, x in zip(folded, cores, first)]
    todo = sorted({x for x, c in zip(typed, cores) if x != c and x})
    found = dict(zip(todo, index.match(todo, cfg)))
    return first, [found.get(x, []) if x != c else [] for x, c in zip(typed, cores)]


def decided(first: list[tuple[float, str]], second: list[tuple[float, str]], margin: float) -> str:
    return clear(first, margin) or clear(second, margin) or UNMATCHED


BEST = "array<struct<rank:double,entry:string>>"


def link_values(df: DataFrame, entries: DataFrame, row_id: str = "candidate_id", column: str = "clean_text", cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(row_id, entry_id): the entry that each value names, or ``unmatched``.

    Each distinct value is matched once. Its result goes back to the rows by a join on the value; hot values, those of more
    than a thousandth of all rows, travel to the rows instead. The list, a stated reference list, is read by the driver
    up to ``cfg.most_entries``; how names split into parts and what trigrams weigh comes from the whole of it. A list over
    ``cfg.max_entries`` is matched in blocks of that size, whose two best entries decide together, so the number of blocks
    doesn't matter.

    Defined results: NULL and blank values give no row; a value that two entries fit equally is unmatched; NULL or
    empty variant lists count as none; an empty list leaves every value unmatched; repeated rows each give theirs; other
    columns don't matter.
    """
    spark = df.sparkSession
    listed = entries.select("entry_id", "canonical_display", "surface_variants").where("entry_id is not null and canonical_display is not null")
    n = listed.count()
    if n > cfg.most_entries:
        raise ValueError(f"{n} entries; a list has at most {cfg.most_entries}")
    letters = {a: b for part in confusables.letters(confusables.prototypes(spark)) for a, b in part.items()}
    look_table(letters)
    whole = Listed.of(sorted((r[0], r[1], [v for v in r[2] or [] if v]) for r in listed.collect()))
    ids = sorted({f[0] for f in whole.forms})
    held = spark.sparkContext.broadcast((whole, letters))
    blocks = [ids[a : a + cfg.max_entries] for a in range(0, len(ids), cfg.max_entries)] or [[]]
    token = uuid.uuid4().hex
    text = F.col(f"`{column}`")
    rows = df.where(text.rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")).select(F.col(f"`{row_id}`").alias("__id"), text.alias("__value"))
    values = rows.groupBy("__value").agg(F.count("*").alias("__n"))

    def matched(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, letters = held.value
            look_table(letters)
            kept = per_worker("gazetteer_index", dict)  # one index at a time, for the tasks of one list and block
            if (token, *block[:1]) not in kept:
                kept.clear()
                kept[token, *block[:1]] = listed.block(block)
            index = kept[token, *block[:1]]
            for b in batches:
                both = resolve(b.column(0), index, cfg, len(blocks) > 1)
                lists = [pa.array([[{"rank": r, "entry": e} for r, e in x] for x in side], pa.list_(pa.struct([("rank", pa.float64()), ("entry", pa.string())]))) for side in both]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["__value", "__n", "first", "second"])

        return values.mapInArrow(run, f"__value string, __n long, first {BEST}, second {BEST}")

    out = reduce(DataFrame.unionByName, map(matched, blocks))
    if len(blocks) > 1:
        out = out.groupBy("__value").agg(F.first("__n").alias("__n"), *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("first", "second")])

    def winner(c: str) -> Column:
        best, next_ = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
        return F.when(best.isNotNull() & (next_.isNull() | (next_["rank"] - best["rank"] >= cfg.margin)), best["entry"])

    known = written(out.select("__value", "__n", F.coalesce(winner("first"), winner("second"), F.lit(UNMATCHED)).alias("entry_id")))
    total = known.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col("__n") > total / 1000).select("__value", "entry_id"))  # fewer than 1000 values
    cold = rows.join(hot, "__value", "left_anti").join(known.where(F.col("__n") <= total / 1000), "__value")
    return rows.join(hot, "__value").select(F.col("__id").alias(row_id), "entry_id").unionByName(cold.select(F.col("__id").alias(row_id), "entry_id"))
