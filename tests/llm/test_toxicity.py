import zlib

import numpy as np
import pytest

from marginalia.llm import toxicity
from marginalia.llm.queries import op5_toxicity

from .helpers import docs_table, odd_rows


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, trained):
    docs, labels, model = trained
    rows = toxicity.scored(docs.join(labels, "doc_id"), model, ["doc_id"]).toPandas()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]]
    y, s = np.array([truth[i] for i in rows["doc_id"]]), rows["score"].to_numpy()
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert np.mean(pairs) > 0.85
    assert (s[y == 0] < 0.5).mean() > 0.85


def test_learns_unseen_forms_of_a_stem():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = lambda *more: " ".join([*rng.choice(words, 40), *more])
    texts = [text() for _ in range(150)] + [text(f"zornig{i}") for i in range(100)]
    model = toxicity.train(texts, [0] * 150 + [1] * 100)
    scorer = toxicity.Scorer(model)
    bad = [scorer.logit(text(f"zornig{i}")) for i in range(500, 530)]
    good = [scorer.logit(text()) for _ in range(30)]
    assert min(bad) > max(good)


def test_long_texts_are_scored_whole(trained, monkeypatch):
    model = trained[2]
    text = "harmless words here " * 300 + "idiot scum moron"
    whole = toxicity.Scorer(model).logit(text)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert toxicity.Scorer(model).logit(text) == pytest.approx(whole, abs=1e-4)
    assert whole > toxicity.Scorer(model).logit("harmless words here " * 300)


def plain_score(model, text):
    """Words times filters at every place, largest value of each filter, one linear layer."""
    found = [model.embedding[[*toxicity.features(w)]].astype(np.float64).sum(0) for w in toxicity.words(text)]
    empty = model.embedding[toxicity.features("")].astype(np.float64).sum(0) * 0
    found = np.array([*found, *[empty] * max(toxicity.WIDTHS)])
    pooled = []
    for kernel, bias in zip(model.filters, model.bias, strict=True):
        at = [sum(found[i + j] @ kernel[j] for j in range(len(kernel))) for i in range(len(found) - len(kernel) + 1)]
        pooled.append(np.max(at, axis=0) + bias)
    return 1 / (1 + np.exp(-(np.maximum(np.concatenate(pooled), 0) @ model.out[:-1] + model.out[-1] - model.shift)))


def test_scores_equal_a_plain_convolution(spark, trained):
    docs, _, model = trained
    rows = docs.orderBy("doc_id").limit(60).collect()
    texts = {r["doc_id"]: r["text"] for r in rows} | {-1: "", -2: "one", -3: "two words"}
    table = docs_table(spark, [(i, t, "en", "a") for i, t in texts.items()])
    for r in toxicity.scored(table, model, ["doc_id"]).collect():
        if len(texts[r["doc_id"]]) < 20_000:
            assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]]), abs=2e-4)


def test_the_driver_gets_bounded_bytes(spark, monkeypatch):
    rows = [(i, ("an idiot " if i % 2 else "a kind word ") * 50, "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    taken, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, *a, **b: taken.append(texts) or train(texts, *a, **b))
    monkeypatch.setattr(toxicity, "CLASS_BYTES", 6_000)
    model = toxicity.fit(docs_table(spark, rows), labels)
    assert 0 < sum(map(len, taken[0])) <= 12_000 and all(t in {r[1] for r in rows} for t in taken[0])
    scorer = toxicity.Scorer(model)
    assert scorer.logit(rows[1][1]) > scorer.logit(rows[0][1])


def test_score_uses_text_only(spark, trained):
    model = trained[2]
    rows = [(i, "an idiot and a clown", lang, s) for i, (lang, s) in enumerate([("en", "a"), ("de", None), (None, "b")])]
    assert len({r["score"] for r in toxicity.scored(docs_table(spark, rows), model, ["doc_id"]).collect()}) == 1


def test_held_out_labels_are_never_read(spark):
    rows = [(i, f"text {i}", "en", "a") for i in range(200)]
    labels = [(i, 1, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)]
    model = toxicity.fit(docs_table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.shift == 30.0 and not model.out.any()  # only one class is left


def test_odd_rows(spark, trained):
    model = trained[2]
    got = toxicity.scored(docs_table(spark, odd_rows()), model, ["doc_id"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject(docs_table(spark, odd_rows()), model)
    assert kept.columns == docs_table(spark, []).columns and kept.count() == sum(not r["toxic"] for r in got)
    assert toxicity.scored(docs_table(spark, []), model, ["doc_id"]).count() == 0


def test_query_columns(spark, sf_dir):
    got = op5_toxicity(spark, sf_dir).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_calibration_sees_all_labelled_rows_that_the_gradient_has_not(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    label = {i: int(i % 9 == 0) for i in range(1800)}
    rows = [(i, " ".join([*rng.choice(words, 20), *(["scum"] if y and i % 4 else [])]), "en" if i % 2 else "de", "a") for i, y in label.items()]
    seen = []
    cut = toxicity.best_cut
    monkeypatch.setattr(toxicity, "best_cut", lambda scores, y, near=None, counts=None, step=0.0: (seen.append((y, counts)), cut(scores, y, near, counts, step))[1])
    labels = spark.createDataFrame([(i, 1, y) for i, y in label.items()], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_table(spark, rows), labels, per_class=50)
    free = [i for i in label if zlib.crc32(str(i).encode()) % 5]
    y, n = seen[0]
    assert n is not None and n.sum() == len(free) - 80  # the gradient takes four fifths of 100
    assert (n * y).sum() > sum(label[i] for i in free) - 50  # few of the toxic ones were in the sample
    assert len(seen) == 3 and sum(c.sum() for _, c in seen[1:]) == n.sum() and set(model.thresholds) == {"de", "en"}


def test_cut_of_counts_equals_cut_of_rows():
    rng = np.random.default_rng(7)
    y = (rng.random(500) < 0.2).astype(int)
    scores = np.floor(rng.normal(y * 2.0, 1) * 64) / 64
    places, back = np.unique(np.stack([scores, y]), axis=1, return_inverse=True)
    counts = np.bincount(back.ravel())
    for near in (None, 0.5):
        a, b = toxicity.best_cut(scores, y, near), toxicity.best_cut(places[0], places[1].astype(int), near, counts)
        assert a == pytest.approx(b)


def test_held_out_texts_are_not_joined(spark, monkeypatch):
    met, join = [], toxicity.join_table
    monkeypatch.setattr(toxicity, "join_table", lambda big, *a: (met.append(big), join(big, *a))[1])
    rows = [(i, "scum word" if i % 3 == 0 else "word", "en", "a") for i in range(300)] + [(None, "word", "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    toxicity.fit(docs_table(spark, rows), labels, per_class=20)
    assert sorted(r["doc_id"] for r in met[0].select("doc_id").collect()) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
