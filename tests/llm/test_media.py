import hashlib
import io
import os
import struct
import tarfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marginalia.llm import common, media
from marginalia.llm.common import new_path, open_fs
from marginalia.llm.queries import op2_media

from .helpers import docs_table, odd_rows


@given(st.binary(max_size=400))
def test_png_round_trip(raw):
    samples = media.padded(raw)
    assert len(samples) % 64 == 0 and len(samples) > 0 and samples[: len(raw)] == raw and not any(samples[len(raw) :])
    stored = media.to_png(samples)
    assert media.from_png(stored) == samples
    assert media.png_header(stored[: media.HEADER_BYTES]) == (64, len(samples) // 64, 8, 0)
    at = 8
    while at < len(stored):  # every chunk's checksum
        (size,) = struct.unpack(">I", stored[at : at + 4])
        assert struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] == zlib.crc32(stored[at + 4 : at + 8 + size])
        at += 12 + size


def test_a_full_block_is_not_padded():
    assert media.padded(b"x" * 64) == b"x" * 64 and media.padded(b"") == bytes(64)


def shards_of(root):
    """All files of all shards, by name; a name that stands there twice is an error."""
    _, path = open_fs(root)
    stored = {}
    for name in os.listdir(path):
        if name.endswith(".tar"):
            with open(f"{path}/{name}", "rb") as f:
                raw = f.read()
            assert tarfile.is_tarfile(io.BytesIO(raw))
            found = media.members(raw)
            assert not found.keys() & stored.keys()
            stored |= found
    return stored


def test_odd_rows(spark):
    docs = docs_table(spark, odd_rows()).repartition(3)
    root = new_path(spark, "media-test")
    out = media.media_table(docs, ["doc_id", "source"], root=root)
    got = out.collect()
    assert len(got) == len(odd_rows())
    expected = sorted(hashlib.sha256(media.padded((t or "").encode())).hexdigest() for _, t, _, _ in odd_rows())
    assert sorted(r["payload_sha256"] for r in got) == expected
    stored = shards_of(root)
    assert sorted(stored) == sorted({f"{d}.png" for d in expected})  # equal texts of all tasks are stored once
    for r in got:
        body = stored[f"{r['digest']}.png"]
        samples = media.from_png(body)
        assert (r["media_bytes"], r["media_sha256"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["payload_bytes"], r["tail_crc32"], r["height"]) == (len(samples), zlib.crc32(samples[-64:]), len(samples) // 64)
        assert r["feature"] == media.feature(samples)


def test_shards_roll_over(spark):
    docs = docs_table(spark, [(i, f"text {i}", "en", "a") for i in range(40)]).coalesce(1)
    root = new_path(spark, "media-test")
    single, shared, repeated = media.store(docs, root, ["doc_id"], shard_bytes=5000)
    assert single.select("shard").distinct().count() > 3 and shared.count() == repeated.count() == 0
    assert {r["doc_id"] for r in media.with_features(single, root).where("payload_sha256 = digest").collect()} == set(range(40))


@pytest.mark.parametrize("rows", [100_000, 0])
def test_one_address_per_payload(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    docs = docs_table(spark, odd_rows() * 3).repartition(5)
    root = new_path(spark, "media-test")
    got = media.manifest_of(*media.store(docs, root, ["doc_id"])).collect()
    digests = [hashlib.sha256(media.padded((t or "").encode())).hexdigest() for _, t, _, _ in odd_rows() * 3]
    assert sorted(r["digest"] for r in got) == sorted(digests)
    assert len({(r["digest"], r["shard"], r["offset"]) for r in got}) == len(set(digests)) == len(shards_of(root))


def test_query_equals_hashlib(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op2_media(spark, d).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = texts[r["doc_id"]]
        samples = media.padded(raw)
        png = media.to_png(samples)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(samples), hashlib.sha256(samples).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(samples[-64:]), len(png), hashlib.sha256(png).hexdigest())
        assert r["feature"] == media.feature(samples)


def test_empty(spark):
    assert media.media_table(docs_table(spark, []), ["doc_id"]).count() == 0
