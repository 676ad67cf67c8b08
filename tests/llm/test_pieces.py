import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import pieces
from marginalia.llm.queries import op4_sentencepiece

from .helpers import docs_table, odd_rows


@pytest.fixture(scope="module")
def both():
    path = pieces.default_model()
    return pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


CASES = ["", " ", "  a", "a  b ", " \n\n x", "▁", "▁▁a", "a▁b", "<0x0A>", "<s>", "</s>[INST] x", "\0", "�", "e" * 500, "=" * 333, "ab" * 300, "\t\r\n", "İı", "🎉👩‍👩‍👧", " " * 70, "the" * 50]


def plain_merges(score, text):
    """Merges by score, the leftmost first among equals."""
    parts = list(text)
    while True:
        found = [(score[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in score]
        if not found:
            return parts
        at = -max(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode([*ids, own.end_id]) == library.decode([*ids, own.end_id])


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_change_nothing(both, monkeypatch, block):
    own, library = both
    monkeypatch.setattr(pieces, "BLOCK", block)
    for text in [*CASES, "The end, said 3.5% of them:\n▁they're here!! " * 3]:
        ids, decoded = own.coded(text)
        assert [int(i) for i in ids.split()] == library.encode(text) and decoded == library.decode(library.encode(text))
        assert "".join(p for parts in own.parts(text) for p in parts) == (" " + text if text else text).replace(pieces.SPACE, " ")


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="the ingER\n▁é漢🎉<>/s0x", max_size=60)))
def test_equals_the_library(both, text):
    text = text.encode("utf-8", "ignore").decode()
    own, library = both
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_decodes_any_ids(both, ids):
    own, library = both
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="▁theingor,s", min_size=1, max_size=30))
def test_last_pieces_are_plain_merges(both, text):
    own, _ = both
    text = text.replace("▁", " ")
    assert [plain_merges(own.score, text[: i + 1])[-1] for i in range(len(text))] == own.last_pieces(text)


def test_two_generations_of_parts(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(pieces, "CACHE", 3)
    for text in ("a b c d e f a b", "a g h i j a k l m n o p", "a b c"):
        assert own.encode(text) == library.encode(text)
    own.young.clear(), own.old.clear()
    for text in ("a b c", "d e f", "a"):
        own.encode(text)
    assert " a" in own.young and len(own.young) <= 3 and len(own.old) == 3


def test_ids_that_do_not_decode_are_an_error(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(own, "_ids", lambda part: [own.end_id])
    own.young.clear(), own.old.clear()
    with pytest.raises(ValueError):
        own.encode("something new")


def test_query_equals_the_library(spark, sf_dir, both):
    own, library = both
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, both):
    _, library = both
    got = pieces.encoded(docs_table(spark, odd_rows()), ["doc_id", "source"]).collect()
    assert sorted(tuple(r["ids"]) for r in got) == sorted(tuple(library.encode(t or "", add_eos=True)) for _, t, _, _ in odd_rows())
    assert pieces.encoded(docs_table(spark, []), ["doc_id"]).count() == 0
