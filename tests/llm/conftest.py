import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one".split()


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, ties, nulls, empty, very long and odd ones."""
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS) + rng.choice(["", "", "a", "er", "ing", "ö", ","])
    prose = lambda n: " ".join(word() if rng.random() < 0.9 else word() + "\n" + word() for _ in range(n))
    out = [prose(rng.randrange(1, 160)) for _ in range(60)]
    passage = prose(70)
    out += [f"{prose(20)} {passage} {prose(30)}" for _ in range(6)] + [passage, passage.upper()]
    out += [out[3], out[3], out[10], None, "", " \n\t ", "x", "one two three", prose(12_000)]
    for _ in range(8):
        words = out[20].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def duck_rows():
    """doc_id -> text after four stages of the pipeline, each by the SQL of its operator."""
    import duckdb

    from plumbline.llm import queries as llm

    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    con.sql("CREATE VIEW benchmark AS SELECT * FROM '/root/testdata/sf0.001/benchmark.parquet'")
    sql = llm.oracle_sql()

    def step(name, columns):
        found = con.sql(sql[name])
        return {r[found.columns.index("doc_id")]: [r[found.columns.index(c)] for c in columns] for r in found.fetchall()}

    def keep(ids):
        con.sql("CREATE OR REPLACE TABLE kept AS SELECT unnest(?) AS doc_id", params=[list(ids)])
        con.sql("DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)")

    keep(d for d, (kept,) in step("op9_quality_rules", ["kept"]).items() if kept)
    keep(d for d, (c,) in step("op4_jaccard_join", ["component_id"]).items() if c == d)
    rows = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    first, texts = {}, {}
    for d, t in rows:
        w = t.encode().split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in rows:
        w, gone = t.encode().split(), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        if len(gone) < len(w) or not w:
            texts[d] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t
    con.sql("DELETE FROM documents")
    con.executemany("INSERT INTO documents (doc_id, text) VALUES (?, ?)", list(texts.items()))
    clean = {d for d, (hit,) in step("op6_decontamination", ["n_hit"]).items() if not hit}
    return {d: t for d, t in texts.items() if d in clean}
