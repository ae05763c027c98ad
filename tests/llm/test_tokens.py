import hashlib
import zlib
from functools import partial

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bytelevel, sentencepiece_codec, token_counts, token_files, wordhash
from plumbline.llm._shared import shared_dir
from plumbline.llm.bytelevel import PieceTable
from plumbline.llm.sentencepiece_codec import PieceEncoder, decode_pieces, encode_pieces
from plumbline.llm.token_counts import count_tokens

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
odd = st.lists(st.sampled_from([*"abcdefe \n\t▁éñ中😀<|endoftext|>.,!-0՘\x00\x1c\u00a0\u2003", "<|endoftext|>", "  ", " the", "ing", "'s", " \n", "\n "]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_pieces_equal_the_library(text):
    encoder, library = _encoders()
    assert encoder.encode(text) == library.encode(text)
    assert encoder.decode(encoder.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(odd, max_size=5))
def test_byte_level_equals_the_library(texts):
    table, library = _tables()
    assert [b"".join(x) for x in table.texts(texts)] == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_a_full_cache_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(bytelevel, "CACHE_ENTRIES", 20)
    table, library = PieceTable(BYTES, token_counts._lengths, {"given": 1}), Tokenizer.from_file(BYTES)
    for k in range(40):
        texts = [f"word{k} given a b c again{k // 3} \n end", "x" * 100 + f" {k} x y"]
        assert list(map(sum, table.texts(texts))) == [len(library.encode(t).ids) for t in texts]


_made: dict = {}


def _encoders():
    if "p" not in _made:
        _made["p"] = PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return _made["p"]


def _tables():
    if "b" not in _made:
        _made["b"] = PieceTable(BYTES, partial(token_files._bytes_of, "<u2")), Tokenizer.from_file(BYTES)
    return _made["b"]


@pytest.mark.parametrize("path", [BYTES, PIECES, P.path("word_bpe_49k.json")])
def test_counts(docs, nothing, path):
    if path.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(path)
        n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in count_tokens(docs.withColumn("n_tokens", docs.n_chars), path).collect():
        assert r.n_tokens == n(r.text or "")
    assert count_tokens(nothing, path).count() == 0


def test_round_trip_of_pieces(docs, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = encode_pieces(docs, PIECES, decoded=True, digests=True)
    for r in encoded.collect():
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert all(r.again == r.decoded for r in decode_pieces(encoded, PIECES, out="again").collect())
    assert encode_pieces(nothing, PIECES).count() == 0


def test_every_sequence_of_a_shard_with_long_documents(tmp_path):
    rng, length = np.random.default_rng(3), 8
    docs = [rng.integers(1, 999, n).astype("<u2") for n in (700, 2000, 9, 1500, 4096, 3, 5000, 77)]
    path = str(tmp_path / "seq.arrow")
    with open(path, "wb") as sink:
        out = token_files._SequenceFile(sink, "<u2", length)
        for ids in docs:
            out.add(ids.tobytes())
        out.close()
    reader, flat = token_files.open_sequences(path), np.concatenate(docs)
    for k in range(-(-len(flat) // length)):
        ids, mask = token_files.sequence(reader, k)
        assert len(ids) == len(mask) == length and ids[mask].tolist() == flat[k * length : (k + 1) * length].tolist()
    assert not mask.all() or len(flat) % length == 0


def test_token_files(spark, docs, nothing, tmp_path):
    twice = docs.unionByName(docs.where("doc_id = 9"))
    folder = shared_dir(spark)
    manifest = token_files.write_token_files(twice, BYTES, folder, end_id=2, length=64, shards=3)
    got = sorted(map(tuple, token_files.read_token_files(spark, manifest, folder).collect()))
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in twice.collect()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    shard = manifest.orderBy("shard").first()
    reader = token_files.open_sequences(f"{folder}/seq-{shard.shard:06d}.arrow")
    ids, mask = token_files.sequence(reader, 0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    none = token_files.write_token_files(nothing, BYTES, shared_dir(spark), end_id=2)
    assert none.count() == 0


def test_a_worker_holds_one_operators_caches():
    want = sentencepiece_codec.encoder(PIECES).encode("some words")
    assert sentencepiece_codec.encoder(PIECES) is sentencepiece_codec.encoder(PIECES)
    hashes = wordhash.word_hashes([b"some", b"words"])
    assert wordhash._words and not sentencepiece_codec._encoders
    assert sentencepiece_codec.encoder(PIECES).encode("some words") == want and not wordhash._words
    assert (wordhash.word_hashes([b"some", b"words"]) == hashes).all()


def test_shards_are_read_by_as_many_tasks(spark):
    folder = shared_dir(spark)
    docs = spark.createDataFrame([(i, f"text {i} of a shard") for i in range(400)] + [(500, "the same row")] * 300, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"), folder, 2, shards=20)
    assert manifest.count() == 20
    read = token_files.read_token_files(spark, manifest, folder)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == 20 and read.count() == 700
    assert max(r.n_docs for r in manifest.collect()) < 300  # repeated rows are dealt over shards
