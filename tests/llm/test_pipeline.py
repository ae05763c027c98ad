import hashlib

import public_tokenizers as P
import sentencepiece

import corpus_pipeline
from plumbline.llm import _shared
from plumbline.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_brute_force(spark, duck_rows):
    docs = duck_rows
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {}
    for d, text in docs.items():
        ids = library.encode(text)
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {d: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for d, r in got.items()} == want


def test_quality_stage_removes_frequent_lines(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"{words(i)}\nAll rights  belong to us.", "en", "src", 1) for i in range(30)] + [(40, f"{words(40)}\nall rights belong to us.", "en", "other", 1), (41, "short\nAll rights belong to us.", "en", "src", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert got[0].text == rows[0][1] and got[40].text == rows[30][1] and 41 not in got
    assert all(got[i].text == words(i) for i in range(1, 30)) and all(r.n_chars == len(r.text) for r in got.values())


def test_quality_stage_leaves_texts_where_they_are(spark, monkeypatch):
    """Whether few documents lose lines, whose keys are broadcast, or more than are broadcast."""
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(12))}\nAll rights belong to us.", "en", None if i % 2 else "src", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    few = corpus_pipeline.quality(spark, docs, SF)
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(_shared, "BROADCAST_KEYS", 0)
    many = corpus_pipeline.quality(spark, docs, SF)
    want = [(i, t if i < 2 else t.split("\n")[0]) for i, t, *_ in rows]
    assert [sorted((r.doc_id, r.text) for r in df.collect()) for df in (few, many)] == [want, want]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(llm.queries())
