import os

import pytest
import sentencepiece

import corpus_pipeline
from marginalia.llm import mixing, pieces, simhash, toxicity

from .helpers import docs_table, odd_rows
from .test_secrets import plain_spans
from .test_simhash import plain_kept


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, d), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(stages, spark):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "secrets", "mixture", "tokens"]
    columns = stages[0][1].columns
    for name, before, after in stages[:-1]:
        assert after.columns == columns, name
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert sorted(ids(after)) == sorted(ids(toxicity.scored(before, model, ["doc_id"]).where("not toxic")))
    _, before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = ids(after)
    assert len(kept) == len(set(kept)) and len({texts[i] for i in kept}) == len(kept)
    order = sorted(texts)
    assert sorted(kept) == [order[i] for i in plain_kept([texts[i] or "" for i in order])]
    _, before, after = stages[2]
    assert sorted(ids(before)) == sorted(ids(after))
    assert not any(plain_spans(r["text"] or "") for r in after.collect())
    _, before, after = stages[3]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_report(before).collect()}
    assert sorted(ids(after)) == sorted(i for i, n in taken.items() for _ in range(n))
    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = sorted(tuple(library.encode(r["text"] or "", add_eos=True)) for r in before.collect())
    assert sorted(tuple(r["ids"]) for r in after.collect()) == want


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_documents_go_through_all_stages(spark, rows):
    docs = docs_table(spark, rows)
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_duplicates":
            kept = docs.collect()
            assert len({simhash.shingle_set(r["text"], 5).tobytes() for r in kept}) == len(kept)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(docs.columns)
    assert sizes == [0] * 5 if not rows else sizes[0] >= sizes[1] == sizes[2] > 0 and sizes[3] == sizes[4]


def test_root():
    assert os.path.exists(corpus_pipeline.__file__)
