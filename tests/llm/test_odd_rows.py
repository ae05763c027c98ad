"""Nulls in any column, repeated rows, long texts, empty tables and clashing column names, for the operators that other files do not try so."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from plumbline.llm._shared import shared_dir
from plumbline.llm.decontamination import contaminated_removed, decontaminate
from plumbline.llm.license_scan import license_scan
from plumbline.llm.quality_rules import quality_rules, remove_frequent_lines
from plumbline.llm.sentencepiece_codec import encode_pieces
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.token_files import read_token_files, write_token_files

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LONG = "word and more words here. " * 40_000
BENCH = "ten words of a benchmark item that texts may hold whole"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, f"we saw {BENCH} today", None, "h"), (1, f"we saw {BENCH} today", None, "h"), (None, f"we saw {BENCH} today", "x", None), (None, None, None, None), (2, "", "y", "h"), (3, " \n\t", "y", "h"), (4, LONG, "z", None), (1, "another text of id one", "x", "h"), (5, "Released under the MIT License.", "x", None), (None, "Released under the MIT License.", "x", None)]
    # The names are those that operators add or use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, source string").selectExpr("*", "n_words AS n_tokens", "n_words AS kept", "n_words AS family", "n_words AS ids", "n_words AS contaminated", "n_words AS w", "n_words AS d", "n_words AS at")


def test_licenses(odd):
    rows = license_scan(odd).collect()
    assert len(rows) == 10 and sorted(str(r.doc_id) for r in rows if r.n_licenses) == ["5", "None"] and {r.text for r in rows if r.n_licenses} == {"Released under the MIT License."} and all(r.family in ("unknown", "mit") for r in rows)


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, BENCH), (1, BENCH), (None, None), (3, "")], "item_id long, text string")
    rows = decontaminate(odd, bench).collect()
    assert len(rows) == 10 and sum(r.contaminated for r in rows) == 3 and {r.n_hit for r in rows} == {0, 11}
    left = contaminated_removed(odd, bench)
    assert left.columns == odd.columns and sorted((r.text or "")[:7] for r in left.collect()) == sorted(["", "", " \n\t", LONG[:7], "another", "Release", "Release"])
    assert contaminated_removed(odd, bench.where("item_id > 9")).count() == 10


def test_token_counts_and_pieces(odd):
    counted = count_tokens(odd, BYTES).collect()
    assert len(counted) == 10 and sorted(r.n_tokens for r in counted)[:2] == [0, 0]
    assert len({(r.text, r.n_tokens) for r in counted}) == len({r.text for r in counted})
    encoded = encode_pieces(odd, PIECES, digests=True).collect()
    assert len(encoded) == 10 and len({(r.text or "", r.ids_sha256) for r in encoded}) == len({r.text or "" for r in encoded})


def test_token_files(spark, odd):
    folder = shared_dir(spark)
    manifest = write_token_files(odd, BYTES, folder, 2)
    got = [(r.doc_id, r.n_tokens) for r in read_token_files(spark, manifest, folder).orderBy("start").collect()]
    assert [d for d, _ in got] == [None, None, None, 1, 1, 1, 2, 3, 4, 5] and dict(got)[2] == 1


def test_quality(odd):
    rows = quality_rules(odd).collect()
    assert len(rows) == 10 and sum(r.n_words == 0 for r in rows) == 3
    assert remove_frequent_lines(odd).count() == 10


def test_pipeline(spark, tmp_path):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, prose(1), "en", "s", 1), (2, prose(1), "en", "s", 1), (2, prose(1), "en", "s", 1), (3, None, None, None, None), (None, prose(4), None, None, None), (5, "", "en", "s", 0), (6, prose(6) + " " + BENCH, "en", "s", 1), (7, prose(7), None, "s", 1), (7, prose(7), None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "lang AS __extra", "doc_id AS component_id")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [0, 1, 7, 7]
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
