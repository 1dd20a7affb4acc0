"""Text similarity from 0 to 100 as Arrow UDFs over whole batches of pairs, since no builtin counts common blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tramloom.functions.blocks import AUTOJUNK, common_at, letters, ratios

Texts = list[str]


def parts(a: Texts, b: Texts) -> np.ndarray:
    """Best ratio of each pair's shorter text with any stretch of the longer one of its length."""
    out = np.zeros(len(a))
    swap = [len(x) > len(y) for x, y in zip(a, b)]
    x, y = [q if s else p for p, q, s in zip(a, b, swap)], [p if s else q for p, q, s in zip(a, b, swap)]
    (fx, sx, lx), (fy, sy, ly) = letters(x), letters(y)
    at = np.flatnonzero(np.array([bool(t.strip()) for t in x], bool))
    big = lx[at] >= AUTOJUNK
    for i in at[big].tolist():
        out[i] = ratios([x[i]] * int(ly[i] - lx[i] + 1), [y[i][k : k + len(x[i])] for k in range(ly[i] - lx[i] + 1)]).max()
    at = at[~big]
    n = ly[at] - lx[at] + 1
    pair = np.repeat(at, n)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    np.maximum.at(out, pair, 200.0 * common_at(fx, sx[pair], lx[pair], fy, sy[pair] + step, lx[pair]) / (2 * lx[pair]))
    return out


def bags(a: Texts, b: Texts) -> np.ndarray:
    """Letters that both texts of a pair have, counted with repeats and whatever their order: no blocks hold more."""
    kinds = {c: i for i, c in enumerate(sorted(set("".join(a)) | set("".join(b))))}

    def counts(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        rows = np.repeat(np.arange(len(number)), [len(t) for t in number])
        cells = np.bincount(rows * len(kinds) + np.array([kinds[c] for t in number for c in t], np.int64), minlength=len(number) * len(kinds)) if len(rows) else np.zeros(len(number) * len(kinds), np.int64)
        return cells.reshape(len(number), -1).astype(np.int16), which

    (x, i), (y, j) = counts(a), counts(b)
    out = np.zeros(len(a), np.int64)
    for s in range(0, len(a), 4096):
        out[s : s + 4096] = np.minimum(x[i[s : s + 4096]], y[j[s : s + 4096]]).sum(1)
    return out


def sorted_words(a: Texts, b: Texts) -> np.ndarray:
    """Ratio of the words of each text in order of the alphabet."""
    key = lambda t: " ".join(sorted(t.split()))
    return ratios([key(t) for t in a], [key(t) for t in b])


def word_sets(a: Texts, b: Texts) -> np.ndarray:
    """The token set ratio. With the sorted common words C, and C followed by the rest of either text's words A and B, it is
    the best ratio of (C, A), (C, B) and (A, B). C begins A and B, so the first two are known from the lengths alone."""
    plain = [(frozenset(x.split()), frozenset(y.split())) for x, y in zip(a, b)]
    full, mine, other = np.zeros(len(plain)), [], []
    for i, (x, y) in enumerate(plain):
        shared = sorted(x & y)
        ends = [" ".join(shared + sorted(w - (x & y))) for w in (x, y)]
        c = len(" ".join(shared))
        if x and y:
            full[i] = max((200.0 * c / (c + len(e)) for e in ends), default=0.0) if c else 0.0
        mine.append(ends[0] if x and y else "")
        other.append(ends[1] if x and y else "")
    return np.maximum(full, ratios(mine, other))


def _udf(f):
    @pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f([x or "" for x in a], [y or "" for y in b]), dtype="float64")

    return run


ratio, partial_ratio, token_sort_ratio, token_set_ratio = _udf(ratios), _udf(parts), _udf(sorted_words), _udf(word_sets)

# The kinds of fuzzy score in the order in which ties are settled, and the most that each may give.
CAPS = {"fuzzy_token_set": 96.0, "fuzzy_partial": 95.0, "fuzzy_token_sort": 94.0, "fuzzy_ratio": 94.0, "folded_token_set": 94.0, "folded_partial": 93.0, "folded_token_sort": 92.0, "folded_ratio": 92.0}
SINGLE_TOKEN_CAP = 84.0


#: Cheap kinds come first; what they find often settles a pair before its stretches are compared.
ORDER = [0, 4, 3, 7, 2, 6, 1, 5]


def best_kinds(a: Texts, b: Texts, fa: Texts, fb: Texts, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The highest capped score of each pair and the number of its kind, the first of equals. A kind is worked out only
    for the pairs where its cap and the letters that both texts have leave room for more; folded texts equal to the
    plain ones give no more than those.

    With ``top``, only the first ``top`` pairs of each text in ``a`` need their exact score: stretches aren't compared
    where they can't lift a pair to the ``top``-th score found so far, and its score is then a lower bound below it."""
    best, kind = np.full(len(a), -1.0), np.full(len(a), len(CAPS))
    if not len(a):
        return best, kind
    names = list(CAPS)
    same = np.array([(x, y) == (p, q) for x, y, p, q in zip(a, b, fa, fb)], bool)
    shared = {f: bags(x, y) for f, x, y in ((False, a, b), (True, fa, fb))}
    sizes = {f: (np.array([len(t) for t in x]), np.array([len(t) for t in y])) for f, x, y in ((False, a, b), (True, fa, fb))}
    number: dict[str, int] = {}
    group = np.array([number.setdefault(t, len(number)) for t in a])
    for k in ORDER:
        name, cap = names[k], CAPS[names[k]]
        folded = k >= 4
        x, y = (fa, fb) if folded else (a, b)
        (m, n), bag = sizes[folded], shared[folded]
        bound = np.full(len(a), cap)
        if k % 4:
            whole = np.minimum(m, n) if k % 4 == 1 else (m + n) / 2
            bound = np.minimum(cap, 100.0 * bag / np.maximum(whole, 1) + 1e-9)
        open_ = ((bound > best) | ((bound >= best) & (k < kind))) & ~(same & folded)
        if top and k % 4 == 1:
            ranked = np.lexsort((-best, group))
            first = np.searchsorted(group[ranked], np.arange(len(number)))
            count = np.bincount(group, minlength=len(number))
            least = np.where(count >= top, best[ranked[np.minimum(first + top - 1, len(a) - 1)]], -1.0)
            open_ &= bound >= least[group]
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        p, q = [x[i] for i in at], [y[i] for i in at]
        if name.endswith("set"):
            value = word_sets(p, q)
        elif name.endswith("partial"):
            value = parts(p, q)
        else:
            value = sorted_words(p, q) if name.endswith("sort") else ratios(p, q)
        value = np.minimum(value, cap)
        more = (value > best[at]) | ((value == best[at]) & (k < kind[at]))
        best[at[more]], kind[at[more]] = value[more], k
    return best, np.minimum(kind, len(CAPS) - 1)


class Names:
    """Listed texts and their folded forms as arrays, by which bounds of their similarity to many phrases are cheap."""

    def __init__(self, plain: Texts, folded: Texts):
        self.forms = [Form(plain), Form(folded)]

    def top_scores(self, a: Texts, fa: Texts, phrase: np.ndarray, entry: np.ndarray, fixed: np.ndarray, top: int, matched: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of its kind) of the pairs of phrases ``a``, folded ``fa``, and entries, as ``best_kinds`` gives
        them with the cap of single words; pairs with a ``fixed`` score keep it, -1 asks for one. The first ``top`` pairs
        of a phrase, ties included, have their exact score; of the others some are lower bounds below those. With ``matched``
        that holds for phrases with a score of at least so much; those of the others are lower bounds below it.

        Of each pair a lower bound (common words) and an upper one (longest common subsequence, common letters) are known
        for all kinds. Pairs are worked out in rounds, the likeliest of each phrase first, until no bound reaches the
        ``top``-th score."""
        caps = np.array(list(CAPS.values()))
        n = len(phrase)
        bound, low = np.zeros((len(caps), n)), np.zeros((2, n))
        for f, (form, texts) in enumerate(zip(self.forms, (a, fa))):
            bound[4 * f : 4 * f + 4], low[f] = form.bounds(texts, phrase, entry)
        bound = np.minimum(bound + 1e-9, caps[:, None])
        plain, folded = np.minimum(low[0], caps[0]), np.minimum(low[1], caps[4])
        best, kind = np.maximum(plain, folded), np.where(plain >= folded, 0, 4)
        names, fnames = (x.texts for x in self.forms)
        same = np.array([x == y for x, y in zip(a, fa)], bool)[phrase] & np.array([x == y for x, y in zip(names, fnames)], bool)[entry]
        cap = np.where(np.array([len(x.split()) == 1 for x in a], bool), SINGLE_TOKEN_CAP, np.inf)[phrase]
        given = fixed >= 0
        none = ~given & ~(np.array([bool(x) for x in a], bool)[phrase] & np.array([bool(x) for x in names], bool)[entry])
        bound[:, none], best[none] = 0, 0
        score = lambda: np.where(given, fixed, np.minimum(best, cap))
        count = np.bincount(phrase, minlength=len(a))

        def least() -> np.ndarray:
            ranked = np.lexsort((-score(), phrase))
            place = np.minimum(np.cumsum(count) - count + top - 1, n - 1)
            return np.where(count >= top, score()[ranked[place]], -1.0)[phrase]

        def work(at: np.ndarray, k: int, floor: np.ndarray) -> None:
            most = bound[k, at]
            at = at[((most > best[at]) | ((most >= best[at]) & (k < kind[at]))) & (np.minimum(most, cap[at]) >= floor[at]) & ~(same[at] & (k >= 4))]
            if not len(at):
                return
            x, y = (fa, fnames) if k >= 4 else (a, names)
            p, q = [x[i] for i in phrase[at]], [y[i] for i in entry[at]]
            value = np.minimum((word_sets, parts, sorted_words, ratios)[k % 4](p, q), caps[k])
            more = (value > best[at]) | ((value == best[at]) & (k < kind[at]))
            best[at[more]], kind[at[more]] = value[more], k

        upper = np.minimum(bound.max(0), cap)
        hope = upper + np.maximum(bound[3], bound[7]) + best
        left, take = ~given & ~none, top + 1
        if matched and n:
            bar = np.full(n, matched)
            first = np.full(len(a), -1.0)
            np.maximum.at(first, phrase, score())
            at = np.flatnonzero(left & (upper >= matched) & (first[phrase] < matched))
            for k in ORDER:
                work(at, k, bar)
            np.maximum.at(first, phrase, score())
            left &= first[phrase] >= matched
        while n:
            floor = least()
            at = np.flatnonzero(left & (upper >= floor))
            if not len(at):
                break
            at = at[np.lexsort((-hope[at], phrase[at]))]
            first = np.searchsorted(phrase[at], phrase[at])
            at = at[np.arange(len(at)) - first < take]
            for k in ORDER[:6]:
                work(at, k, floor)
            floor = least()
            for k in ORDER[6:]:
                work(at, k, floor)
            left[at], take = False, 2 * take
        return np.round(score(), 4), kind


class Form:
    """One form of listed texts: letters as codes, words, and bit masks of where each letter stands."""

    def __init__(self, texts: Texts):
        self.texts = texts
        flat = letters(texts)[0].astype(np.int64)
        self.alphabet = np.unique(flat)
        self.width = len(self.alphabet) + 1
        self.length = np.array([len(t) for t in texts], np.int64)
        self.sorted = [" ".join(sorted(t.split())) for t in texts]
        self.sorted_length = np.array([len(t) for t in self.sorted], np.int64)
        self.masks, self.sorted_masks = self._masks(texts), self._masks(self.sorted)
        self.counts = self._counts(texts)
        sets = [set(t.split()) for t in texts]
        self.set_length = np.array([sum(map(len, w)) + len(w) - 1 for w in sets], np.int64)
        self.of_word: dict[str, np.ndarray] = {}
        for i, w in enumerate(sets):
            for word in w:
                self.of_word.setdefault(word, []).append(i)
        self.of_word = {w: np.array(v, np.int64) for w, v in self.of_word.items()}

    def codes(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all letters one after another, 0 for one that no listed text has, where each text begins, its length."""
        flat, start, length = letters(texts)
        flat = flat.astype(np.int64)
        if not len(self.alphabet):
            return np.zeros(len(flat), np.int64), start, length
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at + 1, 0), start, length

    def _masks(self, texts: Texts) -> np.ndarray:
        code, start, length = self.codes(texts)
        row, place = np.repeat(np.arange(len(texts)), length), np.arange(len(code)) - np.repeat(start, length)
        out, ok = np.zeros((len(texts), self.width), np.uint64), place < 64
        np.bitwise_or.at(out, (row[ok], code[ok]), np.uint64(1) << place[ok].astype(np.uint64))
        return out

    def _counts(self, texts: Texts) -> np.ndarray:
        code, _, length = self.codes(texts)
        out = np.bincount(np.repeat(np.arange(len(texts)), length) * self.width + code, minlength=len(texts) * self.width).reshape(len(texts), self.width)
        out[:, 0] = 0
        return out.astype(np.int16)

    def subsequence(self, texts: Texts, phrase: np.ndarray, entry: np.ndarray, masks: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair, by bits; of listed texts over 64 letters no less."""
        code, start, length = self.codes(texts)
        order = np.argsort(-length[phrase], kind="stable")
        p, e = phrase[order], entry[order]
        many = np.searchsorted(-length[p], -np.arange(int(length[p].max(initial=0))), "left")
        state, base, flat = np.full(len(p), ~np.uint64(0)), e * self.width, masks.ravel()
        for j, k in enumerate(many.tolist()):
            v = state[:k]
            u = v & flat[base[:k] + code[start[p[:k]] + j]]
            state[:k] = (v + u) | (v - u)
        out = np.zeros(len(p), np.int64)
        out[order] = np.bitwise_count(~state)
        short = size[entry] <= 64
        return np.where(short, out, np.minimum(length[phrase], size[entry]))

    def bounds(self, texts: Texts, phrase: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the four kinds, and the lower bound that common words give the first."""
        length = np.array([len(t) for t in texts], np.int64)
        m, n = length[phrase], self.length[entry]
        ordered = [" ".join(sorted(t.split())) for t in texts]
        sm, sn = np.array([len(t) for t in ordered], np.int64)[phrase], self.sorted_length[entry]
        whole = self.subsequence(texts, phrase, entry, self.masks, self.length)
        by_word = self.subsequence(ordered, phrase, entry, self.sorted_masks, self.sorted_length)
        sets = [set(t.split()) for t in texts]
        x, y = np.array([sum(map(len, w)) + len(w) - 1 for w in sets], np.int64)[phrase], self.set_length[entry]
        hits = [(i * len(self.texts) + found, len(w) + 1) for i, ws in enumerate(sets) for w in ws if (found := self.of_word.get(w)) is not None]
        shared = np.zeros(len(phrase), np.int64)
        cell = phrase * len(self.texts) + entry
        if hits and len(cell):
            order = np.argsort(cell, kind="stable")
            at, weight = np.concatenate([h for h, _ in hits]), np.repeat([w for _, w in hits], [len(h) for h, _ in hits])
            place = np.minimum(np.searchsorted(cell[order], at), len(cell) - 1)
            ok = cell[order][place] == at
            shared[order] = np.bincount(place[ok], weights=weight[ok], minlength=len(cell)).astype(np.int64)
        common = np.maximum(shared - 1, 0)
        low = np.where(common > 0, 200.0 * common / np.maximum(common + np.minimum(x, y), 1), 0.0)
        mine, bag = self._counts(texts), np.zeros(len(phrase), np.int64)
        for s in range(0, len(phrase), 4096):
            bag[s : s + 4096] = np.minimum(mine[phrase[s : s + 4096]], self.counts[entry[s : s + 4096]]).sum(1)
        ratio = lambda c, size: 200.0 * c / np.maximum(size, 1)
        return np.stack([np.maximum(low, ratio(np.minimum(bag, np.minimum(x, y)), x + y)), ratio(whole, 2 * np.minimum(m, n)), ratio(by_word, sm + sn), ratio(whole, m + n)]), low


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("match_type", T.StringType())])


def _fuzzy(top: int | None):
    @pandas_udf(SCORED)
    def run(key: pd.Series, other: pd.Series, folded: pd.Series, other_folded: pd.Series) -> pd.DataFrame:
        a, b, fa, fb = (list(s) for s in (key, other, folded, other_folded))
        best, kind = best_kinds(a, b, fa, fb, top)
        names = np.array(list(CAPS))
        single = np.array([len(x.split()) == 1 for x in a], bool)
        none = np.array([not x or not y for x, y in zip(a, b)], bool)
        score = np.where(none, 0.0, np.where(single, np.minimum(best, SINGLE_TOKEN_CAP), best))
        return pd.DataFrame({"score": np.round(score, 4), "match_type": np.where(none, "no_score", names[kind])})

    return run


def fuzzy_score(key: Column, other: Column, folded: Column, other_folded: Column, top: int | None = None) -> Column:
    """(score, match_type): the best capped similarity of two keys and of their folded forms. With ``top`` scores are exact
    for the first ``top`` pairs of a key, and for others maybe lower bounds below those."""
    return _fuzzy(top)(F.coalesce(key, F.lit("")), F.coalesce(other, F.lit("")), F.coalesce(folded, F.lit("")), F.coalesce(other_folded, F.lit("")))
