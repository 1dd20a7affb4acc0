"""Lines, tokens and words of whole batches of texts, and what each line is made of, by array operations only.

A table gives every code point its classes as bits; counts over lines, tokens and words are differences of running
sums, so that no line is looked at by itself.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

from tramloom.functions.workers import per_worker
from tramloom.llm.codes import Codes, Rolling, mixed

NO_WIDTH = re.compile("[­​-‏⁠﻿]")
BREAK_TAG = re.compile(r"<br\s*/?>")

# Classes of characters.
BREAKS = "\n\r\v\f\x85  "
VOWELS = "aeiouyàáâãèéêìíòóôõùúýăĩũơư"
CONSONANTS = "bcdfghjklmnpqrstvwxzđ"
TRIMMED = ".,;:!?()\"“”'"
EDGES = "|~'`^<>[]{}\\"
INSIDE = "'’-./&+,:;!?()%*\"“”­⁠﻿"
MOJIBAKE_FIRST = "ÃÂÄÅÆáâ"
MOJIBAKE_SECOND = "‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ»º"
LIST_MARKS = "-*•+✓✔·▪‣◦–—>"
ALONE = "-–—&+*•/|=<>"
SPLITTING = ";,•|·"

NAMES = ["brk", "space", "letter", "digit", "alnum", "upper", "lower", "vowel", "consonant", "ascii", "trim", "edge", "odd", "moji1", "moji2", "ended", "capital", "b64", "alone", "split", "rule", "mid", "mark", "full", "dd"]
BIT = {n: np.uint32(1 << i) for i, n in enumerate(NAMES)}


def classes(ch: str) -> int:
    o = ord(ch)
    low = ch.lower()
    letter = ch.isalpha()
    has = {
        "brk": ch in BREAKS, "space": ch.isspace(), "letter": letter, "digit": ch.isdigit(), "alnum": ch.isalnum(), "upper": ch.isupper(), "lower": ch.islower(), "vowel": low in VOWELS or 0x1EA0 <= ord(low[0]) <= 0x1EF9,
        "consonant": low in CONSONANTS, "ascii": o < 128, "trim": ch in TRIMMED, "edge": ch in EDGES, "odd": not (ch.isalnum() or ch == "_" or ch.isspace() or ch in INSIDE or 0x200B <= o <= 0x200F or 0x300 <= o <= 0x36F),
        "moji1": ch in MOJIBAKE_FIRST, "moji2": 0x80 <= o <= 0xBF or ch in MOJIBAKE_SECOND, "ended": ch in ".!?…", "capital": "A" <= ch <= "Z" or "À" <= ch <= "Ỹ" or ch == "Đ", "b64": o < 128 and (ch.isalnum() or ch in "+/="),
        "alone": ch in ALONE, "split": ch in SPLITTING, "rule": ch.isspace() or ch in "|:+=-", "mid": ch in ".,!", "mark": ch in LIST_MARKS, "full": ch in ".!?…:;", "dd": low == "đ",
    }
    return sum(int(BIT[k]) for k, v in has.items() if v)


class _Table:
    """Classes and lower case of the code points met so far."""

    def __init__(self) -> None:
        self.bits, self.lower = np.zeros(0x110000, np.uint32), np.arange(0x110000, dtype=np.uint32)
        self.known = np.zeros(0x110000, bool)

    def learn(self, cp: np.ndarray) -> None:
        if self.known[cp].all():
            return
        for o in np.flatnonzero((np.bincount(cp, minlength=0x110000) > 0) & ~self.known).tolist():
            ch = chr(o)
            self.bits[o], self.known[o] = classes(ch), True
            self.lower[o] = ord(ch.lower()) if len(ch.lower()) == 1 else o


def prepared(texts: pa.Array) -> pa.Array:
    """Composed texts without characters of no width, written breaks as breaks."""
    out = []
    for t in texts.to_pylist():
        if t and not t.isascii():
            t = NO_WIDTH.sub("", unicodedata.normalize("NFC", t))
        out.append(BREAK_TAG.sub("\n", t) if t and "<br" in t else t)
    return pa.array(out, pa.string())


def word_hash(word: str) -> int:
    return int(Rolling(np.array([ord(c) for c in word.lower()], np.uint32)).spans(np.array([0]), np.array([len(word)]))[0])


class Lines:
    """The lines of a batch that aren't blank, of all texts one after another. ``doc``: their text; ``first[d]`` ..
    ``first[d+1]`` are text d's; other fields hold a number a line."""

    def __init__(self, texts: pa.Array, common: np.ndarray, plain: np.ndarray):
        """``common``, ``plain``: sorted hashes of the function words and of their accent-free forms, which count in lines of
        ASCII only."""
        codes = Codes(prepared(texts))
        table: _Table = per_worker("line_classes", _Table)
        table.learn(codes.cp)
        cp, bits, lower = codes.cp, table.bits[codes.cp], table.lower[codes.cp]
        n = len(cp)
        self.n_texts = len(codes.start)
        has = lambda name: (bits & BIT[name]) != 0
        begins = np.zeros(n + 1, bool)
        begins[codes.start] = True
        begins[n:] = True

        def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts and stops of the runs of ``inside`` that no text's begin cuts."""
            start, stop = inside.copy(), inside.copy()
            start[1:] &= ~inside[:-1] | begins[1:n]
            stop[:-1] &= ~inside[1:] | begins[1:n]
            return np.flatnonzero(start), np.flatnonzero(stop) + 1

        def sums(flag: np.ndarray):
            total = np.zeros(n + 1, np.int32)
            total[1:] = flag
            np.cumsum(total, out=total)
            return lambda a, b: total[b] - total[a]

        brk, space = has("brk"), has("space")
        row_start, row_stop = runs(~brk)
        ts, te = runs(~space)
        tl = _last_before(row_start, ts, n)
        kept, tl = np.unique(tl, return_inverse=True)
        k = self.n = len(kept)
        if not k:
            self.doc, self.first = np.empty(0, np.int64), np.zeros(self.n_texts + 1, np.int64)
            return
        t0 = np.searchsorted(tl, np.arange(k))  # first token of each line
        t1 = np.append(t0[1:], len(ts)) - 1  # last
        ls, le = ts[t0], te[t1]
        self.doc = np.searchsorted(codes.stop, ls, "right")
        self.first = np.searchsorted(self.doc, np.arange(self.n_texts + 1))
        per_line = lambda flag_of_token: np.bincount(tl, weights=flag_of_token, minlength=k)
        letter, digit, ended = has("letter"), has("digit"), has("ended")
        n_letter, n_digit = sums(letter), sums(digit)
        n_tokens = self.tokens = np.bincount(tl, minlength=k)
        size = te - ts
        dense = self.dense = per_line(size).astype(np.int64)
        letters, digits = n_letter(ls, le), n_digit(ls, le)
        alnums = sums(has("alnum"))(ls, le)
        bar = cp == 0x7C
        self.bars = sums(bar)(ls, le)
        rule = self.rule = (sums(~has("rule"))(ls, le) == 0) & (sums(cp == 0x2D)(ls, le) > 0)
        self.ascii = sums(~has("ascii"))(ls, le) == 0
        self.symbols = 1 - alnums / dense
        self.ended = has("full")[le - 1]

        # words
        ws, we = runs(has("alnum"))
        wl = _last_before(ls, ws, n)
        self.words = np.bincount(wl, minlength=k)
        wh = Rolling(lower).spans(ws, we)
        known = np.where(self.ascii[wl], _among(wh, plain), _among(wh, common))
        self.known = np.bincount(wl, weights=known, minlength=k).astype(np.int64)
        self.word_length = np.bincount(wl, weights=we - ws, minlength=k) / np.maximum(self.words, 1)
        distinct = np.bincount(_distinct(wl, wh), minlength=k)
        repeated = (self.words >= 8) & (distinct <= np.minimum(0.25 * self.words, 12))

        # marks, layout
        nxt, prv = np.append(cp[1:], 0x0A), np.append(np.uint32(0x0A), cp[:-1])
        nspace, pspace = np.append(space[1:], True), np.append(True, space[:-1])
        nspace[codes.stop[codes.stop > codes.start] - 1] = True
        nxt[codes.stop[codes.stop > codes.start] - 1] = 0x0A
        pspace[codes.start[codes.start < n]] = True
        head_len = size[t0]
        head = ts[t0]
        paren = cp[head] == 0x28
        inner = n_digit(head, head + head_len)
        closing = cp[head + head_len - 1]
        numbered = (inner >= 1) & (inner <= 3) & (inner == head_len - 1 - paren) & ((closing == 0x2E) | (closing == 0x29))
        self.marked = (n_tokens >= 2) & (((head_len == 1) & has("mark")[head]) | numbered)
        self.tags = per_line(cp[ts] == 0x23) >= 0.6 * n_tokens
        cut = (has("split") & nspace) | ((cp == 0x2F) & nspace & pspace)
        self.items = 1 + sums(cut)(ls, le - 1)
        self.heading = cp[le - 1] == 0x3A
        tab = cp == 0x09
        at_edge = np.zeros(n, bool)
        at_edge[ls] = at_edge[le - 1] = True
        blank = cp == 0x20
        bs, be = runs(blank)
        wide = (be - bs >= 2) & ~pspace[bs] & ~nspace[be - 1]
        gap = np.zeros(n, bool)
        gap[bs[wide]] = True
        self.tabs = sums(tab)(ls, le)
        self.cells = 1 + self.tabs + sums(bar & ((pspace & nspace) | at_edge))(ls, le) + sums(gap)(ls, le)
        no_blank = nxt != 0x20
        fields = [1 + sums((cp == ord(c)) & no_blank)(ls, le) for c in ",;|"]
        near = np.zeros(k, np.int64)
        same = self.doc[1:] == self.doc[:-1]
        for f in fields:
            low = np.minimum(f[1:], f[:-1])
            fit = np.where(same & (low >= 3) & (np.abs(f[1:] - f[:-1]) <= 1), low, 0)
            near[1:] = np.maximum(near[1:], fit)
            near[:-1] = np.maximum(near[:-1], fit)
        self.near = near

        # sentences: two letters, final punctuation, then the line's end or a capital
        es, ee = runs(ended)
        es, ee = es[nspace[ee - 1]], ee[nspace[ee - 1]]
        el = np.searchsorted(ls, es, "right") - 1
        ok = (es >= 2) & (el >= 0)
        es, ee, el = es[ok], ee[ok], el[ok]
        ok = letter[es - 1] & letter[es - 2] & (es - 2 >= ls[el])
        es, ee, el = es[ok], ee[ok], el[ok]
        after = np.searchsorted(ts, ee)  # next token
        final = ee >= le[el]
        follows = ~final & has("capital")[ts[np.minimum(after, len(ts) - 1)]]
        self.sentence = np.bincount(el[final | follows], minlength=k) > 0

        # damage of tokens
        trim = has("trim")
        keep = np.flatnonzero(~trim & ~space)
        a = np.searchsorted(keep, ts)
        b = np.searchsorted(keep, te) - 1
        full = b >= a
        cs = np.where(full, keep[np.minimum(a, len(keep) - 1)] if len(keep) else 0, ts)
        ce = np.where(full, keep[np.maximum(b, 0)] + 1 if len(keep) else 0, ts)
        core = ce - cs
        lower_, upper = sums(has("lower")), sums(has("upper"))
        n_low, n_up, n_core_letters, n_core_digits = lower_(cs, ce), upper(cs, ce), n_letter(cs, ce), n_digit(cs, ce)
        alpha = full & (n_core_letters == core)
        is_upper = (n_up > 0) & (n_low == 0)
        vowels = sums(has("vowel"))(cs, ce)
        plain_or_d = (sums(~has("ascii"))(cs, ce) == 0) | (sums(has("dd"))(cs, ce) > 0)
        http = np.zeros(n, bool)
        if n >= 4:
            http[:-3] = (cp[:-3] == 0x68) & (cp[1:-2] == 0x74) & (cp[2:-1] == 0x74) & (cp[3:] == 0x70)
        link = sums(http)(ts, np.maximum(ts, te - 3)) > 0
        hashed = sums(cp == 0x23)(cs, ce) > 0
        coded = (core >= 20) & (sums(has("b64"))(cs, ce) == core) & (n_low > 0) & (n_up > 0) & (n_core_digits > 0)
        spoiled = full & (coded | ((core > 40) & ~hashed & ~link))
        pletter, nletter = np.append(False, letter[:-1]), np.append(letter[1:], False)
        question = cp == 0x3F
        pair = np.zeros(n, bool)
        pair[:-1] = has("moji1")[:-1] & has("moji2")[1:]
        n_pair = sums(pair)
        moji = (n_pair(ts, te - 1) > 0) | (sums(cp == 0xFFFD)(ts, te) > 0)
        inside_q = question & nletter & (pletter | np.append(False, question[:-1]))
        odd_in = has("odd") & pletter & nletter
        moji |= sums(inside_q)(np.minimum(ts + 1, te), np.maximum(te - 1, np.minimum(ts + 1, te))) > 0
        odd_inside = sums(odd_in)(np.minimum(ts + 1, te), np.maximum(te - 1, np.minimum(ts + 1, te))) > 0
        edge = has("edge")
        not_edge = np.flatnonzero(~edge)
        lead = np.searchsorted(not_edge, ts)
        lead = not_edge[np.minimum(lead, len(not_edge) - 1)] if len(not_edge) else ts
        tail = np.searchsorted(not_edge, te) - 1
        tail = not_edge[np.maximum(tail, 0)] if len(not_edge) else te
        odd_edge = (edge[ts] & (lead < te) & letter[np.minimum(lead, n - 1)]) | (edge[te - 1] & (tail >= ts) & letter[np.maximum(tail, 0)])
        # letters, then . , or !, then letters to the token's end
        not_letter = np.flatnonzero(~letter)
        end_run = np.searchsorted(not_letter, te) - 1
        stop_at = not_letter[np.maximum(end_run, 0)] if len(not_letter) else np.zeros(len(ts), np.int64)
        mid = has("mid")
        not_mid = np.flatnonzero(~mid)
        before = np.searchsorted(not_mid, stop_at, "right") - 1
        before = not_mid[np.maximum(before, 0)] if len(not_mid) else np.zeros(len(ts), np.int64)
        odd_edge |= letter[te - 1] & (end_run >= 0) & (stop_at >= ts) & mid[stop_at] & (before >= ts) & letter[before]
        odd_edge &= ~link
        mute = alpha & (core >= 2) & plain_or_d & (vowels == 0) & ~is_upper
        five = np.zeros(n, bool)
        cons = has("consonant")
        if n >= 5:
            five[:-4] = cons[:-4] & cons[1:-3] & cons[2:-2] & cons[3:-1] & cons[4:]
        cluster = alpha & ~is_upper & (core >= 5) & (sums(five)(cs, np.maximum(cs, ce - 4)) > 0)
        loud = alpha & is_upper & (core >= 5) & (vowels == 0)
        alone = full & ~alpha & (core == 1) & ~has("alnum")[np.minimum(cs, n - 1)] & ~has("alone")[np.minimum(cs, n - 1)]
        bad = full & (moji | odd_inside | odd_edge | mute | cluster | loud | alone)
        share = per_line(bad) / n_tokens
        share[per_line(spoiled) > 0] = 1.0

        # damage of whole lines
        longest = np.maximum.reduceat(size, t0)
        shortest = np.minimum.reduceat(size, t0)
        whole = (letters + digits < 0.5 * (dense - self.bars)) & ~rule
        whole |= (letters == 0) & (digits >= 0.7 * dense) & ((shortest >= 4) | (n_tokens == 1)) & (longest >= 4)
        # few different characters: a 64-bit set of them can only hold fewer, so only lines with few bits are counted
        seen = _or_by_line(lower, space, ls, le)
        most = 5 + np.minimum(dense // 40, 3)
        maybe = np.flatnonzero((dense >= 24) & (np.bitwise_count(seen) <= most))
        for i in maybe.tolist():
            part = lower[ls[i] : le[i]]
            whole[i] |= len(np.unique(part[~space[ls[i] : le[i]]])) <= most[i]
        # a short run of characters, again and again
        solid = np.flatnonzero(~space)
        sl = np.repeat(np.arange(k), dense)
        body = cp[solid]
        big = dense >= 30
        for step in range(1, 7):
            if len(body) <= step:
                break
            hit = (body[step:] == body[:-step]) & (sl[step:] == sl[:-step])
            whole |= big & (np.bincount(sl[:-step][hit], minlength=k) >= 0.8 * (dense - step))
        self.bad = np.where(repeated | whole, 1.0, share)


def _last_before(starts: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Index of the last start at or before each place."""
    seen = np.zeros(n, np.int32)
    seen[starts] = 1
    np.cumsum(seen, out=seen)
    return seen[at].astype(np.int64) - 1


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(h), bool)
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h


def _distinct(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The line of each distinct (line, hash)."""
    if len(line) and line[-1] >= 1 << 24:
        return np.unique(np.stack([line.astype(np.uint64), h], 1), axis=0)[:, 0].astype(np.int64)
    key = np.sort(mixed(h) >> np.uint64(24) | line.astype(np.uint64) << np.uint64(40))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return (key[new] >> np.uint64(40)).astype(np.int64)


def _or_by_line(lower: np.ndarray, space: np.ndarray, ls: np.ndarray, le: np.ndarray) -> np.ndarray:
    """The set of each line's characters as bits, folded into 64."""
    bit = np.where(space, np.uint64(0), np.uint64(1) << (lower & np.uint32(63)).astype(np.uint64))
    cuts = np.stack([ls, le], 1).ravel()
    cuts = cuts[:-1] if cuts[-1] >= len(bit) else cuts
    return np.bitwise_or.reduceat(bit, cuts)[::2]
