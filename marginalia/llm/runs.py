"""Periodic run detection: maximal stretches of words that repeat with a period.

A run is a stretch with smallest period q (words q apart are equal) of at least
max(``shortest``, 2q) words that no neighbouring word extends. Runs are enumerated on a
harmonic grid: a run of period p holds both i and i + p for some multiple i of p, so for
every p the pairs (i, i + p) are asked how far their words agree to the right (L) and to the
left (B); L + B >= p is a run from i - B to i + p + L. That is n ln n questions for n words.

A question (longest common extension, LCE) is answered by a difference cover: of any two
positions some shift below ``MODULUS`` brings both to positions whose residues are in
``COVER``. Only suffixes at such positions are sorted (ranks of blocks, then doubling); an
LCE compares words up to the shift, and behind it is the minimum of the sorted neighbours'
common prefixes, from a sparse table. Left extensions are those of the reversed words. A
stretch that has a period p below its smallest one is reported once, with the smallest.

Texts of one batch are handled as one sequence with a unique mark on both sides of each, so no
run crosses a text. Nothing is shuffled; a text of any length is processed whole, in memory
that grows with its words (some 150 bytes a word) and not with its runs' pairs, which are asked ``PAIRS`` at a time.

Nulls and ties: a null text has no words and no runs. Rows with equal texts have equal
results; a null id is a value like any other. Columns besides the kept ones may have any
names; kept ones must not be named n_words, runs or collapsed. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, map_rows, with_fields

#: A perfect difference set: every residue but 0 is a difference of exactly one pair.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Pairs of the grid that are asked at once, and words of one sequence, unless one text has more.
PAIRS, WORDS = 1 << 19, 1 << 18

WORD = r"[^\x20\x09-\x0D]+"


def _shifts() -> np.ndarray:
    """The smallest shift that brings residues (a, b) into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    at = np.arange(MODULUS)[:, None] + np.arange(MODULUS)
    return np.argmax(inside[at][:, None, :] & inside[at][None, :, :], axis=2).astype(np.int64)


_SHIFT = _shifts()
_PLACE = np.searchsorted(COVER, np.arange(MODULUS))


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


class Extensions:
    """LCE of suffixes of a sequence whose last value occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words = words
        n, per = len(words), len(COVER)
        at = (np.arange(0, n, MODULUS)[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        padded = np.concatenate([words.astype(np.int64), np.zeros(MODULUS, np.int64)])
        base = int(padded.max()) + 1
        rank, known = np.zeros(len(at), np.int64), 0
        while known < MODULUS and (known == 0 or rank.max() + 1 < len(at)):  # ranks of blocks, as many words at a time as fit a key
            top = int(rank.max()) + 1
            while known < MODULUS and top < (1 << 62) // base:
                rank = rank * base + padded[at + known]
                top, known = top * base, known + 1
            rank = _ranks(rank)
        levels, step = [rank], per
        while rank.max() + 1 < len(at):  # doubling: the block behind is ``step`` samples on
            behind = np.zeros(len(at), np.int64)
            behind[:-step] = rank[step:] + 1
            rank = _ranks(rank * (len(at) + 1) + behind)
            levels.append(rank)
            step *= 2
        self.rank = rank.astype(np.int32)
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        self.table = [self._neighbours(at, order, levels)]
        width = 1
        while 2 * width <= len(at):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sorted sample with the one before it; 0 for the first."""
        out = np.zeros(len(order), np.int32)
        a, b = order[:-1].copy(), order[1:].copy()
        for level in range(len(levels) - 1, -1, -1):
            of = levels[level]
            ok = np.flatnonzero((np.maximum(a, b) < len(at)) & (of[np.minimum(a, len(at) - 1)] == of[np.minimum(b, len(at) - 1)]))
            out[ok + 1] += MODULUS << level
            a[ok] += len(COVER) << level
            b[ok] += len(COVER) << level
        left, right = at[order[:-1]] + out[1:], at[order[1:]] + out[1:]
        live = np.arange(len(left))
        while len(live):
            live = live[self.words[left[live]] == self.words[right[live]]]
            left[live] += 1
            right[live] += 1
            out[live + 1] += 1
        return out

    def _sample(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // MODULUS * len(COVER) + _PLACE[at % MODULUS]].astype(np.int64)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i[k] and j[k] on, where i[k] != j[k]."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out, live, t = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        synced = [live[:0]]
        while len(live):
            done = shift[live] <= t
            synced.append(live[done])
            live = live[~done]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            t += 1
            out[live] = t
        at = np.concatenate(synced)
        a, b = self._sample(i[at] + shift[at]), self._sample(j[at] + shift[at])
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            table = self.table[k]
            out[at[own]] = shift[at[own]] + np.minimum(table[low[own]], table[high[own] + 1 - (1 << int(k))])
        return out


def _first_of(stretches: np.ndarray) -> np.ndarray:
    """(start, end, period) sorted, one row per start and end with the smallest period."""
    stretches = stretches[np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))]
    new = np.ones(len(stretches), bool)
    new[1:] = (stretches[1:, :2] != stretches[:-1, :2]).any(axis=1)
    return stretches[new]


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shortest: int) -> np.ndarray:
    """(start, end, period) of all runs, sorted, in a sequence of texts that lie at starts and have marks between and around them."""
    right, turned = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    many = (sizes[text] - 1) // period  # multiples i of the period with i + period inside
    ends, found, at = np.cumsum(many), [np.zeros((0, 3), np.int64)], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        p = np.repeat(period[at:to], n)
        i = np.repeat(starts[text[at:to]], n) + (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * p
        ahead, back = words[i] == words[i + p], words[i - 1] == words[i + p - 1]
        some = np.flatnonzero(ahead | back)
        i, p, ahead, back = i[some], p[some], ahead[some], back[some]
        after, before = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        after[ahead] = right(i[ahead], i[ahead] + p[ahead])
        before[back] = turned(len(words) - i[back], len(words) - i[back] - p[back])
        ok = (after + before >= p) & (after + before + p >= shortest)
        found.append(_first_of(np.stack([i - before, i + p + after, p], axis=1)[ok]))
        at = to
    return _first_of(np.concatenate(found))


def _grouped(sizes: list[int]):
    """Ranges of texts with at most WORDS words together, or one text."""
    at = 0
    while at < len(sizes):
        to, total = at + 1, sizes[at]
        while to < len(sizes) and total + sizes[to] <= WORDS:
            total += sizes[to]
            to += 1
        yield at, to
        at = to


def runs_of(texts: list[list[bytes]], shortest: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """(start, length, period) of the runs of each list of words, by start and then period, and its words without repeats, joined by spaces."""
    out = []
    for a, b in _grouped([len(t) for t in texts]):
        part = texts[a:b]
        sizes = np.array([len(t) for t in part])
        coded = pa.array([w for t in part for w in t], pa.large_binary()).dictionary_encode()
        ids, marks = np.asarray(coded.indices, np.int64), len(coded.dictionary)
        starts = np.cumsum(sizes) - sizes + np.arange(len(part)) + 1
        words = np.full(len(ids) + len(part) + 1, -1, np.int64)
        words[np.arange(len(ids)) + np.repeat(np.arange(len(part)), sizes) + 1] = ids
        words[words < 0] = marks + np.arange(len(part) + 1)
        found = find_runs(words, starts, sizes, shortest)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, found[:, 0] + found[:, 2], 1)
        np.add.at(edge, found[:, 1], -1)
        gone = np.cumsum(edge) > 0
        cut = np.searchsorted(found[:, 0], np.append(starts, len(words)))
        for k, t in enumerate(part):
            own = found[cut[k] : cut[k + 1]]
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            listed = list(zip((own[:, 0] - starts[k]).tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist(), strict=True))
            kept = t if not listed else [w for w, x in zip(t, gone[starts[k] : starts[k] + len(t)].tolist(), strict=True) if not x]
            out.append((listed, b" ".join(kept)))
    return out


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", shortest: int = 12) -> DataFrame:
    """keep, n_words, runs array<struct<start,length,period>> by start and period, collapsed (the text without the repeats of its runs)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            words = [(t or "").encode().split() for t in batch.column("__text").to_pylist()]  # bytes.split() knows exactly the six ASCII white spaces
            found = runs_of(words, shortest)
            names = ("start", "length", "period")
            return {"n_words": [len(w) for w in words], "runs": [[dict(zip(names, r, strict=True)) for r in runs] for runs, _ in found], "collapsed": [kept.decode() for _, kept in found]}

        return step

    extra = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(docs.select(*keep, F.col(text).alias("__text")), with_fields(docs, keep, extra), make)


def wrapped(text: Column, key: Column) -> Column:
    """The text, or for one key hash in ten its words from some place on replaced by a repeating stretch of them.

    With h = crc32 of the key's decimal form and g = h div 10, texts with h % 10 = 0 have from word a = g % n on the words
    a + (i - a) % p with p = 1 + (n - a) div (3 + g % 8), joined by single spaces. A null key changes nothing.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def damaged(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i, at: F.when(i < at["a"], i).otherwise(at["a"] + F.pmod(i - at["a"], at["p"])).cast("int")
        return let(F.struct(start.alias("a"), period.alias("p")), lambda at: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, place(i, at))))

    joined = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda ws: F.when(F.size(ws) > 0, F.array_join(damaged(ws), " ")).otherwise(F.lit("")))
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), joined).otherwise(text)
