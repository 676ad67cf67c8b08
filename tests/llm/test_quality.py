import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import quality
from marginalia.llm.queries import op9_quality

from .helpers import docs_table, odd_rows

N, PAD = quality.ORDER, quality.PAD


def plain_model(texts):
    """p(character, context) by the textbook recursion over dictionaries."""
    counts = {N: Counter()}
    for t in texts:
        s = PAD * (N - 1) + t
        counts[N].update(s[i - N + 1 : i + 1] for i in range(N - 1, len(s)))
    for n in range(N - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        discount[n] = [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i - 0.1) if of[i] else i / 2 for i in (1, 2, 3)]
    totals, freed = {n: Counter() for n in counts}, {n: defaultdict(float) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            totals[n][g[:-1]] += k
            freed[n][g[:-1]] += discount[n][min(k, 3) - 1]

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        context = gram[:-1]
        if not totals[n][context]:
            return lower
        k = counts[n][gram]
        off = discount[n][min(k, 3) - 1] if k else 0
        return (k - off) / totals[n][context] + freed[n][context] / totals[n][context] * lower

    def perplexity(t):
        s = PAD * (N - 1) + t
        return math.exp(-sum(math.log(p(s[i - N + 1 : i + 1])) for i in range(N - 1, len(s))) / len(t))

    return perplexity


TRAIN = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "the mat is on the log, the cat is not"]
SCORED = ["the cat is on the log", "zzz qqq", "t", "the\nmat", "漢字 the cat", "on the mat sat the dog and the cat " * 20]


@pytest.mark.parametrize("shard_rows,block", [(10**6, 1 << 20), (20, 1 << 20), (20, 50), (10**6, 7)])
def test_perplexity_equals_plain_recursion(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    info = quality.publish(quality.model_table(quality.gram_counts(train, "text")), shard_rows)
    assert (info["shards"] > 1) == (shard_rows == 20)
    plain = plain_model(TRAIN)
    reader = quality.Reader(info)
    monkeypatch.setattr(quality, "HELD_BYTES", 1)
    for text, total in zip(SCORED, reader.totals(SCORED), strict=True):
        assert math.exp(-total / len(text)) == pytest.approx(plain(text), rel=1e-9)


def test_a_hot_character_fills_no_shard(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 2)) for _ in range(4000)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, 4000, 200)]
    info = quality.publish(quality.model_table(quality.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")), 1000)
    rows = {r["shard"]: r["count"] for r in spark.read.parquet(info["path"]).where("shard >= 0").groupBy("shard").count().collect()}
    assert info["shards"] > 10 and max(rows.values()) < sum(rows.values()) / 10  # a third of all characters are spaces
    monkeypatch.setattr(quality, "HELD_BYTES", 1)
    reader, plain = quality.Reader(info), plain_model(texts)
    asked = [*texts[:2], "it is not here"]
    for text, total in zip(asked, reader.totals(asked), strict=True):
        assert math.exp(-total / len(text)) == pytest.approx(plain(text), rel=1e-9)
    assert len(reader.held) == 1


def test_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    reader = quality.Reader(quality.publish(quality.model_table(quality.gram_counts(train, "text"))))
    alphabet = sorted(set("".join(TRAIN))) + ["一"]  # one unseen character has what is left
    for context in ("the ", "zzzz", PAD * 4, "n th"):
        total = 0.0
        for c in alphabet:
            points = np.array([ord(x) for x in context + c], np.uint32)
            total += math.exp(reader.log_probs(points, np.array([4]))[0])
        assert total == pytest.approx(1, abs=1e-9)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    find = quality.Lookup(keys, np.arange(5000.0))
    assert (find(keys.view(np.uint64)) == np.arange(5000)).all()
    assert np.isnan(find(rng.integers(0, 2**63, 500, dtype=np.uint64))).all()
    assert np.isnan(quality.Lookup(keys[:0], np.empty(0))(keys[:3].view(np.uint64))).all()


def test_keys_of_grams():
    points = np.array([ord(c) for c in "abcdef漢"], np.uint32)
    for n in range(1, N + 1):
        grams = ["abcdef漢"[i - n + 1 : i + 1] for i in range(n - 1, 7)]
        assert (quality.keys_of(grams).view(np.uint64) == quality.hashes(points, n)[n - 1 :]).all()


def test_keeps_clean_and_drops_junk(spark):
    clean = ["the cat sat on the mat and the dog sat on the log", "a dog and a cat sat on the log", "the mat is not on the log"]
    rows = [(i, f"{clean[i % 3]} {clean[(i // 3) % 3]}", "en", "a") for i in range(300)]
    rows += [(1000 + i, "T#H$E %%% C^A*T !!! xqzv " * 3, "en", "a") for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs_table(spark, rows), trusted).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_odd_rows(spark):
    trusted = spark.createDataFrame([(1,), (1,), (5,), (None,)], "doc_id long")
    got = quality.classify(docs_table(spark, odd_rows()), trusted).collect()
    assert len(got) == len(odd_rows())
    assert all((r["perplexity"] is None) == (r["n_chars_scored"] == 0) and not (r["n_chars_scored"] == 0 and r["keep"]) for r in got)
    none = quality.classify(docs_table(spark, odd_rows()), trusted.where("doc_id < 0")).collect()
    assert len(none) == len(odd_rows()) and not any(r["keep"] for r in none)
    assert quality.classify(docs_table(spark, []), trusted).count() == 0


def test_query_equals_plain_recursion(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    train = [r["doc_id"] for r in good.where(~quality.held_back()).collect()]
    plain = plain_model([texts[i] for i in train if i in texts])
    got = op9_quality(spark, sf_dir).collect()
    assert got
    for r in got[::5]:
        assert r["perplexity"] == pytest.approx(plain(texts[r["doc_id"]]), rel=1e-9) and r["perplexity"] <= r["threshold"]


def test_query_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in op9_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good, bad = [r["doc_id"] in kept for r in labels if r["quality"] == 1], [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_only_texts_for_training_are_joined(spark, monkeypatch):
    """Whole texts meet the trusted ids once; those that calibrate meet them as scores."""
    met, join = [], quality.join_table
    monkeypatch.setattr(quality, "join_table", lambda big, *a: (met.append(big), join(big, *a))[1])
    trusted = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    rows = [(i, "the cat sat on the mat", "en", "a") for i in range(200)]
    got = quality.classify(docs_table(spark, rows), trusted)
    assert got.count() == 200 and got.where("keep").count() == 200
    wide = [big for big in met if "text" in big.columns]
    assert len(wide) == 1 and wide[0].count() < 200 and wide[0].where(quality.held_back()).count() == 0
