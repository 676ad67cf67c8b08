import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import runs
from marginalia.llm.queries import op11_runs
from tests.llm.helpers import docs_table, odd_rows


def plain_runs(words, shortest):
    """Every period in turn, every stretch that keeps it."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, 2 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    found = sorted((s, e - s, p) for (s, e), p in best.items())
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return found, b" ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts():
    rng = random.Random(7)
    for _ in range(150):
        kinds, n = rng.choice([1, 2, 3, 40]), rng.choice([0, 1, 2, 11, 12, 13, 40, 130, 400])
        words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a = rng.randrange(n - 10)
            p = rng.randrange(1, max(2, (n - a) // 2))
            words[a:] = [words[a + i % p] for i in range(n - a)]
        yield words


@pytest.mark.parametrize("shortest", [2, 12])
@pytest.mark.parametrize("most", [50, 1 << 18])
def test_equals_plain_search(monkeypatch, shortest, most):
    monkeypatch.setattr(runs, "WORDS", most)
    monkeypatch.setattr(runs, "PAIRS", most)
    texts = list(some_texts())
    assert runs.runs_of(texts, shortest) == [plain_runs(t, shortest) for t in texts]


def test_cover_brings_all_residues_together():
    inside = set(runs.COVER)
    for a in range(runs.MODULUS):
        for b in range(runs.MODULUS):
            k = int(runs._SHIFT[a, b])
            assert {(a + k) % runs.MODULUS, (b + k) % runs.MODULUS} <= inside and k < runs.MODULUS


@pytest.mark.parametrize("kinds", [1, 2, 1000])
def test_extensions(kinds):
    rng = np.random.default_rng(kinds)
    words = np.append(rng.integers(0, kinds, 700), kinds)
    lce = runs.Extensions(words)
    i, j = rng.integers(0, 700, 3000), rng.integers(0, 700, 3000)
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while words[a + n] == words[b + n]:
            n += 1
        return n

    assert lce(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def damaged(doc_id, text):
    words = text.encode().split()
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_equals_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r.asDict() for r in op11_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        found, kept = plain_runs(damaged(d["doc_id"], d["text"] or ""), 12)
        some += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        said = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        row = got[d["doc_id"]]
        assert row["n_runs"] == len(found)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
    assert some > 10


def test_damage_of_odd_texts(spark):
    rows = [(i, t) for i in range(-20, 60) for t in ("", " \t", "one", "a b c d e f g h i j k l m n o p q r s t", "x  y\nz ünï")] + [(None, "a b c"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in table.select("doc_id", "text", runs.wrapped(table["text"], table["doc_id"]).alias("out")).collect():
        assert (r["out"] or "").encode().split() == damaged(r["doc_id"], r["text"] or "")


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    out = runs.periodic_runs(docs_table(spark, rows), ["doc_id", "lang"]).collect()
    assert len(out) == len(rows)
    want = sorted((repr(i), repr(la), plain_runs((t or "").encode().split(), 12)) for i, t, la, _ in rows if not t or len(t) < 9999)
    got = sorted((repr(r["doc_id"]), repr(r["lang"]), ([tuple(x) for x in r["runs"]], r["collapsed"].encode())) for r in out if r["doc_id"] != 5)
    assert got == want
    long = next(r for r in out if r["doc_id"] == 5)
    assert [tuple(x) for x in long["runs"]] == [(0, 20_000, 5)] and long["collapsed"] == "lorem ipsum dolor sit amet"


def test_empty_table(spark):
    assert runs.periodic_runs(docs_table(spark, []), ["doc_id"]).collect() == []


def test_words_are_cut_at_six_white_spaces_only():
    text = "a\x0bb\x0cc\x1cd\x85e\xa0f g"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", text)
