"""Chunks of documents. A chunk keeps its document's id, source and other columns; chunk_idx counts from 0."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import stripped, tokens


def _exploded(docs: DataFrame, pieces) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(pieces).alias("chunk_idx", "text"))


#: Windows of a block, at least.
BLOCK = 3


def chunk_window(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Windows of ``size`` characters, one every ``size - overlap``; the text is cut anywhere.

    To find a place in a text Spark counts characters from its start, so texts are cut into blocks of windows first, about as many blocks as a block has
    windows: the work is that of n ** 1.5 characters, not of n ** 2.
    """
    stride, size = config.size - config.overlap, config.size
    rows = docs.where("text is not null").withColumn("__last", F.ceil(F.greatest(F.length("text") - size, F.lit(0)) / F.lit(stride)).cast("int"))
    last = F.col("__last")  # a column, as an expression would count the text's characters again wherever it stands
    each = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(last)).cast("int"))
    block = lambda b: F.struct(F.least(each, last + 1 - b * each).alias("n"), F.substring(F.col("text"), b * each * stride + 1, (each - 1) * stride + size).alias("text"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / each).cast("int")), block)
    within = lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: stripped(F.substring(x["text"], (i - 1) * stride + 1, F.lit(size))))
    windows = F.flatten(F.transform(F.filter(blocks, lambda x: x["n"] > 0), within))
    return _exploded(rows, F.filter(windows, lambda t: t != "")).drop("__last")


def _occurrences(points: np.ndarray, separator: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a separator begins within one of the segments, leftmost first and without overlap."""
    n, found = len(separator), np.arange(max(0, len(points) - len(separator) + 1))
    for i, c in enumerate(separator):
        found = found[points[found + i] == ord(c)]
    own = np.searchsorted(starts, found, "right") - 1
    found = found[(own >= 0) & (found + n <= ends[own])]
    if n > 1 and (np.diff(found) < n).any():
        kept, free = [], 0
        for p in found.tolist():
            if p >= free:
                kept.append(p)
                free = p + n
        found = np.array(kept, np.int64)
    return found


def _windows(at: list[int], config: ChunkConfig) -> Iterator[tuple[int, int]]:
    """Merges pieces that lie between neighbours of ``at``: as many as fit a chunk, then again from the first piece that the overlap and the next piece leave room for."""
    i, last = 0, len(at) - 1
    while True:
        j = max(bisect_right(at, at[i] + config.size) - 1, i + 1)
        yield at[i], at[j]
        if j == last:
            return
        i = bisect_left(at, max(at[j] - config.overlap, at[j + 1] - config.size), i, j)


def split_batch(texts: Sequence[str], config: ChunkConfig = ChunkConfig()) -> list[list[str]]:
    """Chunks of each text: the first separator that occurs cuts it, pieces that are too long are cut again by the later
    ones, and short neighbours are merged with an overlap.

    All texts are one sequence of characters. A separator's places are found in all of it at once; segments that are
    still too long go on to the next separator. Pieces are offsets, and only chunks become strings.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    limits = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    starts, ends = limits[:-1], limits[1:]
    starts, ends = starts[ends > starts], ends[ends > starts]
    chunks: list[tuple[int, int, bool]] = []  # start, end, and whether it is stripped
    add = lambda a, b, strip: chunks.extend(zip(a.tolist(), b.tolist(), [strip] * len(a), strict=True))
    for level, separator in enumerate(config.separators):
        short = ends - starts < config.size
        add(starts[short], ends[short], True)  # whatever it is cut into fits one chunk again
        starts, ends = starts[~short], ends[~short]
        if not len(starts):
            break
        cuts = _occurrences(points, separator, starts, ends) if separator else np.concatenate([np.empty(0, np.int64), *map(np.arange, starts, ends)])
        cut = np.zeros(len(starts), bool)
        cut[np.searchsorted(starts, cuts, "right") - 1] = True
        first = np.unique(np.concatenate([starts[cut], cuts]))
        own = np.searchsorted(starts, first, "right") - 1
        same = own[1:] == own[:-1]
        end = np.append(np.where(same, first[1:], ends[own[:-1]]), ends[own[-1:]])
        long = end - first >= config.size
        joins = np.append(False, same & ~long[1:] & ~long[:-1])  # to the piece before
        begin = np.flatnonzero(~joins & ~long)
        stop = np.append(np.flatnonzero(~joins), len(first))
        stop = stop[np.searchsorted(stop, begin, "right")]  # behind the group's last piece
        fits = end[stop - 1] - first[begin] <= config.size
        add(first[begin[fits]], end[stop[fits] - 1], True)
        for a, b in zip(begin[~fits].tolist(), stop[~fits].tolist(), strict=True):
            chunks.extend((x, y, True) for x, y in _windows([*first[a:b].tolist(), int(end[b - 1])], config))
        starts, ends = (np.sort(np.concatenate(x)) for x in ((starts[~cut], first[long]), (ends[~cut], end[long])))
    add(starts, ends, False)  # no separator is left
    out: list[list[str]] = [[] for _ in texts]
    chunks.sort()
    owner = np.searchsorted(limits, np.array([a for a, _, _ in chunks], np.int64), "right") - 1
    for (a, b, strip), text in zip(chunks, owner.tolist(), strict=True):
        if chunk := joined[a:b].strip() if strip else joined[a:b]:
            out[text].append(chunk)
    return out


def split_recursive(text: str, config: ChunkConfig = ChunkConfig()) -> list[str]:
    """Chunks of one text."""
    return split_batch([text], config)[0]


def chunk_recursive(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks at paragraphs, lines, words, in this order of preference."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series(split_batch(texts.tolist(), config), index=texts.index, dtype=object)

    return _exploded(docs.where("text is not null"), split("text"))


def truncate_tokens(rows: DataFrame, limit: int = 512) -> DataFrame:
    """Adds tokens: the first ``limit`` words of the text, which itself stays whole."""
    return rows.withColumn("tokens", tokens(F.col("text"), limit))
