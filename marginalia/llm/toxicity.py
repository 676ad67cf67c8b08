"""Toxicity by a convolutional text classifier in numpy.

A word (lower-cased, outer punctuation stripped) has the sum of the hashed embeddings of
itself and of its beginnings of 4 to 7 letters, so that unseen forms of a known
stem are scored too. Filters of widths 1, 2 and 3 slide over the words of the whole text;
the maximum of each filter feeds a logistic output. Its zero point is set, and thresholds are
calibrated by language, on all labelled training rows that the gradient has not seen: they are scored
in the tasks, and histograms of their scores by language and label decide. Language,
source and id are never inputs of a score.

Training starts twice, and the model that fits a held-back fifth of its sample better stays. It uses a bounded sample: at most ``per_class`` labelled ids of each class, those
with the smallest MD5, with their whole texts (of several rows with one id, the text with the smallest MD5). It is
collected to the driver, the model goes to the tasks with the function (about 5 MB). Scoring
covers every row and whole texts. Long ones are trained on and scored in blocks that overlap by two words.

Nulls and ties: a null or empty text is scored like a text without words. Labels that are
null count as unlabelled; ids without a row in the labels just are not trained on. A null language is one with an empty name.
Repeated rows get equal scores, and reruns the same model. With fewer than two classes in the sample all scores are 0. Columns of docs
besides doc_id, text and lang may have any names; kept ones must not be named score, threshold or toxic. Empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hold, join_table, lean, map_rows, slices, with_fields, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
STEMS = (4, 5, 6, 7)
PER_CLASS = 2_500
#: Bytes of the texts of one label that the driver trains on.
CLASS_BYTES = 32 << 20
#: Starts of the training; the model with the smallest loss on held-back rows of the sample is taken.
SEEDS = (3, 4)
#: Bins of a histogram of scores for each unit of a logit.
BINS = 64
#: Words of a block of a long text, and words that a task keeps by name.
BLOCK, CACHE = 1 << 15, 80_000
STRIP = ".,;:!?\"'()[]{}<>*#%&$|-_"


def features(word: str) -> list[int]:
    raw = [word, *(word[:n] + "^" for n in STEMS if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw]


def words(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in (text or "").lower().split()]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def tables(self, rows: np.ndarray) -> np.ndarray:
        """What a word adds to each filter at each of its places."""
        return np.concatenate([rows @ f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pooled(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and its place for each filter, over words with the given tables."""
        best, where, at = [], [], 0
        for f, b in zip(self.filters, self.bias, strict=True):
            n = len(parts) - len(f) + 1
            x = parts[:n, at : at + FILTERS]
            for j in range(1, len(f)):
                x = x + parts[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            place = x.argmax(0)
            best.append(x[place, np.arange(FILTERS)] + b)
            where.append(place)
            at += len(f) * FILTERS
        return np.concatenate(best), np.concatenate(where)

    def pooled_ids(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same over words by number, known holding their vectors, in blocks of BLOCK words."""
        best, where = self.pooled(self.tables(known[ids[: BLOCK + max(WIDTHS) - 1]]))
        for at in range(BLOCK, len(ids) - max(WIDTHS) + 1, BLOCK):
            more, place = self.pooled(self.tables(known[ids[at : at + BLOCK + max(WIDTHS) - 1]]))
            where = np.where(more > best, place + at, where)
            best = np.maximum(best, more)
        return best, where

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled, 0) @ self.out[:-1] + self.out[-1] - self.shift)


def new_model(seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    embedding[BUCKETS] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS) + 1).astype(np.float32))


class Vocabulary:
    """Word numbers and their hashed features; number 0 is padding."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.hashed: list[list[int]] = [[BUCKETS] * (1 + len(STEMS))]

    def numbers(self, found: list[str]) -> np.ndarray:
        get, out = self.number.get, []
        for w in found:
            i = get(w)
            if i is None:
                i = self.number[w] = len(self.hashed)
                h = features(w)
                self.hashed.append(h + [BUCKETS] * (1 + len(STEMS) - len(h)))
            out.append(i)
        return np.array(out + [0] * max(WIDTHS), np.int64)


def vectors(embedding: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Sums of hashed embeddings; the last row of the table is zero."""
    return embedding[hashed].sum(1)


def train(texts: list[str], labels: list[int], epochs: int = 10, rate: float = 0.1, batch: int = 16, seed: int = 3) -> Model:
    """Adagrad on the logistic loss in small batches; classes weigh the same.

    A third of the words is left out at random each time, so that the evidence of a text isn't
    left to its single strongest word.
    """
    model, vocabulary, rng = new_model(seed), Vocabulary(), np.random.default_rng(seed)
    docs = [vocabulary.numbers(words(t)) for t in texts]
    hashed = np.array(vocabulary.hashed)
    y = np.array(labels)
    weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    seen_e, seen_o = np.full(BUCKETS + 1, 1e-2, np.float32), np.full_like(model.out, 1e-2)
    seen, seen_b = [np.full_like(f, 1e-2) for f in model.filters], [np.full(FILTERS, 1e-2, np.float32) for _ in WIDTHS]
    known = vectors(model.embedding, hashed)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            g_out, g_f, g_b = np.zeros_like(model.out), [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.bias]
            at_words, at_grads = [], []
            for d in order[first : first + batch]:
                ids = docs[d]
                left = rng.random(len(ids)) < 0.67
                left[-max(WIDTHS) :] = True
                ids = ids[left]
                pooled, where = model.pooled_ids(ids, known)
                on = (pooled > 0).astype(np.float32)
                p = 1 / (1 + np.exp(-np.clip(model.logit(pooled), -30, 30)))
                g = np.float32((p - y[d]) * weight[d])
                if abs(g) < 1e-3:
                    continue
                g_out += np.append(g * pooled * on, g).astype(np.float32)
                g_pool = g * model.out[:-1] * on
                for k, f in enumerate(model.filters):
                    gk = g_pool[k * FILTERS : (k + 1) * FILTERS]
                    places = where[k * FILTERS : (k + 1) * FILTERS, None] + np.arange(len(f))
                    g_f[k] += (gk[:, None, None] * known[ids[places]]).transpose(1, 2, 0)
                    g_b[k] += gk
                    at_words.append(ids[places].ravel())
                    at_grads.append((gk[:, None, None] * f.transpose(2, 0, 1)).reshape(-1, DIM))
            if not at_words:
                continue
            for value, grad, total in [(model.out, g_out, seen_o), *zip(model.filters, g_f, seen, strict=True), *zip(model.bias, g_b, seen_b, strict=True)]:
                total += grad**2
                value -= rate * grad / np.sqrt(total)
            touched, back = np.unique(np.concatenate(at_words), return_inverse=True)
            by_word = np.zeros((len(touched), DIM), np.float32)
            np.add.at(by_word, back, np.concatenate(at_grads))
            rows, back = np.unique(hashed[touched], return_inverse=True)
            by_row = np.zeros((len(rows), DIM), np.float32)
            np.add.at(by_row, back.ravel(), np.repeat(by_word, hashed.shape[1], axis=0))
            seen_e[rows] += (by_row**2).mean(1)
            model.embedding[rows] -= rate * by_row / np.sqrt(seen_e[rows])[:, None]
            model.embedding[BUCKETS] = 0
            known[touched] = vectors(model.embedding, hashed[touched])
    return model


def best_cut(scores: np.ndarray, y: np.ndarray, near: float | None = None, counts: np.ndarray | None = None, step: float = 0.0) -> float:
    """A cut with the largest F1: the one closest to ``near``, else the middle of the widest gap, at most 1 below a score.

    counts: how often each score stands there; a score stands for those from it to ``step`` above it.
    """
    order = np.argsort(-scores)
    n = np.ones(len(y), np.int64) if counts is None else counts[order]
    high = scores[order]
    low = np.append(high[1:], high[-1] - 2)
    f1 = 2 * np.cumsum(y[order] * n) / (np.cumsum(n) + max((y[order] * n).sum(), 1))
    f1[high <= low] = -1
    low = low + step
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    if near is not None:
        return float(min((np.clip(near, min(low[i] + 1e-6, high[i]), high[i]) for i in best), key=lambda c: abs(c - near)))
    i = max(best, key=lambda i: high[i] - low[i])
    return float(high[i] - min(high[i] - low[i], 2.0) / 2)


class Scorer:
    """Scores whole texts; the filter tables of up to CACHE words are kept by name."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.known = np.zeros((1 << 12, sum(WIDTHS) * FILTERS), np.float32)

    def _numbers(self, found: list[str]) -> list[int]:
        if len(self.number) > CACHE:
            self._reset()
        number = self.number
        fresh = [w for w in dict.fromkeys(found) if w not in number]
        if fresh:
            first = len(number)
            number.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            size = len(self.known)
            while len(number) > size:
                size *= 2
            if size > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((size - len(self.known), self.known.shape[1]), np.float32)])
            rows = [features(w) for w in fresh]
            hashed = np.array([h + [BUCKETS] * (1 + len(STEMS) - len(h)) for h in rows])
            wide = vectors(self.model.embedding, hashed).astype(np.float64)  # rounded afterwards, so that a word's row doesn't depend on its neighbours
            self.known[first : len(number)] = self.model.tables(wide)
        return [number[w] for w in found]

    def logit(self, text: str | None) -> float:
        found, best = words(text), None
        for at in range(0, max(len(found), 1), BLOCK):
            ids = self._numbers(found[at : at + BLOCK + max(WIDTHS) - 1])
            if at + BLOCK >= len(found):  # only the end of a text is padded
                ids += [0] * max(WIDTHS)
            pooled, _ = self.model.pooled(self.known[ids])
            best = pooled if best is None else np.maximum(best, pooled)
        return self.model.logit(best)


def scorer_of(model: Model) -> Scorer:
    """One scorer per worker process and model, so that its words outlive a task."""
    return hold(("toxicity", model.name), lambda: Scorer(model))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def loss(model: Model, texts: list[str], y: np.ndarray) -> float:
    """Logistic loss; classes weigh the same."""
    scorer = Scorer(model)
    logits = np.array([scorer.logit(t) for t in texts])
    each = np.logaddexp(0, np.where(y == 1, -logits, logits))
    return float(sum(each[y == k].mean() for k in (0, 1) if (y == k).any()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """labels: doc_id and the label; rows that held_out() names are never read.

    The driver trains on whole texts of at most per_class documents of each label, in order of a hash, while these take at most CLASS_BYTES.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("__label")).where(F.col("doc_id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out()).distinct()
    order = F.md5(F.col("doc_id").cast("string"))
    some = [usable.where(F.col("__label") == y).orderBy(order).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows at most
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).join(sample, "doc_id")
    one = F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text", "lang")).alias("one")
    drawn = written(rows.groupBy(order.alias("o"), "__label").agg(one).select("one.text", "one.lang", "__label", "o"), "toxicity-sample")  # 2 * per_class rows at most
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("__label").orderBy("o"))
    found = drawn.withColumn("bytes", before).where(F.col("bytes") <= CLASS_BYTES).drop("bytes").collect()
    discard(drawn)
    found.sort(key=lambda r: (r["o"], r["__label"]))
    back_ids = set(sorted({r["o"] for r in found})[::5])
    y = np.array([r["__label"] for r in found])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((BUCKETS + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS) + 1, np.float32), shift=30.0)
    back = np.array([r["o"] in back_ids for r in found])
    texts = [r["text"] for r in found]
    fitted, held = [t for t, b in zip(texts, back, strict=True) if not b], [t for t, b in zip(texts, back, strict=True) if b]
    model = min((train(fitted, y[~back].tolist(), seed=seed) for seed in SEEDS), key=lambda m: loss(m, held, y[back]))
    del fitted, held
    lean()  # the driver goes on with the model alone
    seen = docs.sparkSession.createDataFrame([(o,) for o in sorted({r["o"] for r, b in zip(found, back, strict=True) if not b})], "o string")
    rest = usable.withColumn("o", order).join(F.broadcast(seen), "o", "left_anti")
    labels_of = written(rest.groupBy("doc_id").agg(F.count(F.when(F.col("__label") == 0, 1)).alias("clean"), F.count(F.when(F.col("__label") == 1, 1)).alias("toxic")), "toxicity-labels")
    bins = histogram(docs.where(F.col("doc_id").isNotNull() & ~held_out()), labels_of, model)  # the others have no label here, so their texts need not be joined
    if not 0 < bins["toxic"].sum() or not 0 < bins["clean"].sum():
        scorer = Scorer(model)
        logits = np.array([np.floor(scorer.logit(r["text"]) * BINS) for r in found], np.int64)
        bins = pd.DataFrame({"lang": [r["lang"] for r in found], "bin": logits, "clean": 1 - y, "toxic": y})
    model.shift = cut_of(bins)
    for lang, own in bins.groupby("lang"):
        if min(own["toxic"].sum(), own["clean"].sum()) >= 20:
            model.thresholds[lang] = float(sigmoid(cut_of(own, model.shift) - model.shift))
    model.name = uuid.uuid4().hex  # workers may hold a scorer of the model without its zero point
    return model


def histogram(docs: DataFrame, labels_of: DataFrame, model: Model) -> pd.DataFrame:
    """lang, bin (of 1 / BINS of a logit), clean, toxic: how many labelled rows have such a score. labels_of: a written row per doc_id."""
    rows = join_table(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")), labels_of, ["doc_id"], "inner")

    def make():
        scorer = scorer_of(model)

        def step(batch):
            return {"bin": [math.floor(scorer.logit(t.as_py()) * BINS) for t in batch.column("text")]}

        return step

    found = map_rows(rows.select("lang", "clean", "toxic", "text"), with_fields(rows, ["lang", "clean", "toxic"], "bin long"), make)
    return found.groupBy("lang", "bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()


def cut_of(bins: pd.DataFrame, near: float | None = None) -> float:
    both = bins.groupby("bin")[["clean", "toxic"]].sum().reset_index()
    at, y = np.concatenate([both["bin"], both["bin"]]) / BINS, np.repeat([0, 1], len(both))
    n = np.concatenate([both["clean"], both["toxic"]]).astype(np.int64)
    return best_cut(at[n > 0], y[n > 0], near, n[n > 0], 1 / BINS)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """keep, score, threshold (of the row's language, else 0.5), toxic."""

    def make():
        scorer = scorer_of(model)

        def step(batch):
            scores = [sigmoid(scorer.logit(t.as_py())) for t in batch.column(text)]
            cuts = [model.thresholds.get(x or "", 0.5) for x in batch.column(lang).to_pylist()]
            return {"score": scores, "threshold": cuts, "toxic": [s >= c for s, c in zip(scores, cuts, strict=True)]}

        return step

    return map_rows(docs.select(*dict.fromkeys([*keep, text, lang])), with_fields(docs, keep, "score double, threshold double, toxic boolean"), make)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches the threshold of their language."""

    def run(batches):
        import pyarrow as pa

        lean()
        scorer = scorer_of(model)
        for batch in (part for whole in batches for part in slices(whole)):
            keep = [sigmoid(scorer.logit(t.as_py())) < model.thresholds.get(x or "", 0.5) for t, x in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
