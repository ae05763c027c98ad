import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plumbline.llm import _shared, decontamination
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.jaccard_join import jaccard_classes, near_duplicates_removed
from plumbline.llm.license_scan import license_scan, model
from plumbline.llm.lm_scoring import MARK, lattice, score_documents, train
from plumbline.llm.quality_rules import quality_rules, remove_frequent_lines
from plumbline.llm import substring_dedup
from plumbline.llm.substring_dedup import dedup_substrings, lz_factors

PIECES = P.path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("window", [50, 7])
def test_substrings_equal_brute_force(docs, nothing, window):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    got = {r.doc_id: r for r in dedup_substrings(docs, window, digest=True).collect()}
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    changed = {r.doc_id: r for r in dedup_substrings(docs, window).collect()}
    assert all(changed[d].text == t for d, t in rows if not changed[d].n_removed)
    assert dedup_substrings(nothing, window).count() == 0


@pytest.mark.parametrize("window, hot", [(50, 1_000), (7, 1_000), (50, 2), (7, 2)])
def test_factors_equal_a_naive_parse(docs, window, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    reference, whole = {}, {}
    for d, t in rows:
        w = words(t)
        whole.setdefault(tuple(w), d)
        for i in range(len(w) - window + 1):
            reference.setdefault(tuple(w[i : i + window]), (d, i))
    expected = {}
    for d, t in rows:
        w, i, factors = words(t), 0, []
        if len(w) >= window and whole[tuple(w)] < d:
            expected[d] = [(0, len(w), whole[tuple(w)], 0)]
            continue
        while i + window <= len(w):
            source, place = reference[tuple(w[i : i + window])]
            if source == d:
                i += 1
                continue
            length = window  # the longest match from here
            while i + length < len(w) and reference[tuple(w[i + length - window + 1 : i + length + 1])] == (source, place + length - window + 1):
                length += 1
            factors.append((i, length, source, place))
            i += length - window + 1  # the boundary: the next phrase is the first that lies across it
        if factors:
            expected[d] = factors
    got = {r.doc_id: list(zip(r.starts, r.lengths, r.sources, r.source_starts)) for r in lz_factors(docs, window).collect()}
    assert got == expected and any(len(f) > 1 for f in expected.values())


def test_substrings_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long, "a"), (5, long, "a"), (5, long + " more", "b"), (None, long, "c"), (9, "x " + long, "d"), (9, "other", "e"), (11, long, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(0, 80, 0), (5, 80, 0), (5, 80, 0), (5, 81, 0), (9, 1, 0), (9, 81, 80), (11, 80, 80)]


def test_jaccard_with_odd_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (2, b, "z"), (None, a, "u"), (None, None, "v"), (3, None, "v"), (3, "", "v"), (4, a + " more", "w"), (4, a + " less", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_classes(df).collect())
    assert got == sorted([(1, 46, 1), (2, 46, 1), (2, 46, 2), (2, 46, 2), (0, 46, 1), (0, 0, 0), (3, 0, 3), (3, 0, 3), (4, 47, 1), (4, 47, 1)])
    left = sorted((r.doc_id or 0, r.text or "") for r in near_duplicates_removed(df).collect())
    assert left == sorted([(1, a), (2, b), (2, b), (0, a), (0, ""), (3, ""), (3, "")])


def test_jaccard_of_many_sets_around_shared_passages(spark):
    """Sets that share most of their shingles and are just no links, and some that are."""
    import random

    rng = random.Random(7)
    shared = [f"s{i}" for i in range(120)]
    rows = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(rng.choice([4, 8, 12, 16, 24]))]
        rows.append((k, " ".join(own[: len(own) // 2] + shared + own[len(own) // 2 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = _sets(df)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {r.doc_id: r.component_id for r in jaccard_classes(df).collect()} == {d: root(d) for d in sets}


def _sets(docs):
    out = {}
    for r in docs.collect():
        w = words(_lower(r.text))
        out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_jaccard_equals_brute_force(docs, nothing):
    sets = _sets(docs)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r for r in jaccard_classes(docs).collect()}
    assert {d: (got[d].n_shingles, got[d].component_id) for d in sets} == {d: (len(s), root(d)) for d, s in sets.items()}
    assert sum(root(d) != d for d in sets) > 5
    assert {r.doc_id for r in near_duplicates_removed(docs).collect()} == {d for d in sets if root(d) == d}
    assert jaccard_classes(nothing).count() == 0


def test_jaccard_chains_that_one_pivot_does_not_link(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(9):  # each links with the next ones only
        own = [f"x{i}" if i < 5 * k else w for i, w in enumerate(base)]
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard_classes(df).collect()} == {0}


def test_decontamination_equals_brute_force(spark, docs, nothing, texts):
    items = [(1, " ".join(words(texts[5])[:30])), (2, "one two three"), (3, None), (4, "!!"), (50, texts[60].upper()), (6, " ".join(words(texts[7])[3:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, _lower(t))
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    hits = 0
    for r in docs.collect():
        w, hit, found = split(r.text), set(), set()
        for item, t in items:
            v = split(t)
            n = min(10, len(v))
            wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].item_ids) == (len(w), len(hit), sorted(found))
        hits += bool(hit)
    assert hits > 5
    assert decontaminate(nothing, bench).count() == 0
    assert decontaminate(docs, bench.where("item_id < 0")).where("contaminated").count() == 0


def test_decontamination_splits_between_words(spark):
    """The same words as by matching them, at edges, in other scripts and between all ASCII characters, without matching."""
    ascii_all = "".join(f"Q{chr(c)}z" for c in range(128))
    odd = [None, "", " ", "a", " a", "a ", "..A-b..", "ÄÖ İx ß", "\x00a\x00", "\x7fa\x80b\x7f", "日本語 \U0001f600Z,\U0001f600", "a\r\n\tb\u2028c\u00a0d", ascii_all, "@[`{A Z"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    want = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t)) for i, t in enumerate(odd)}
    assert {r.doc_id: r.w for r in df.select("doc_id", decontamination.words_of(df["text"]).alias("w")).collect()} == want
    found = decontaminate(df, spark.createDataFrame([("i", "a")], "item_id string, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()} == {i: (len(w), w.count("a")) for i, w in want.items()}
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def _base(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_rules(spark, docs, nothing):
    many = spark.createDataFrame([(1000 + i, f"shared line of the host\nand one more shared line here\nx{i}", "en", "src0", 1) for i in range(30)] + [(2000, "again and again and again and again and again and again", "en", "s", 1)], docs.schema)
    every = docs.unionByName(many)
    got = {r.doc_id: r for r in quality_rules(every, max_docs=20).collect()}
    for r in every.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == _base(r.text)
    assert got[1000].kept and not any(got[1000 + i].kept for i in range(1, 30)) and got[1005].n_line_words == 11
    assert not got[2000].kept
    cut = {r.doc_id: r.text for r in remove_frequent_lines(every, max_docs=20).collect()}
    assert cut[1000].count("\n") == 2 and cut[1007] == "x7" and len(cut) == every.count()
    assert quality_rules(nothing).count() == 0


def test_license_scan(spark, docs, nothing):
    own = model()
    assert own.recall_unseen > 0.3  # of notices that its folds have not seen
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "All rights reserved."), (3, "the license of the driver"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].families == "mit" and got[2].families == "all-rights-reserved" and got[6].families == "apache-2.0,cc-by-nc"
    assert [got[i].n_licenses for i in (3, 4, 5)] == [0, 0, 0] and got[1].n_paragraphs == 3
    for i in (1, 2, 6):
        assert got[i].probability == pytest.approx(max(own.predict(x)[1] for x in dict(rows)[i].split("\n") if own.predict(x)[0] != "unknown"), abs=1e-5)
    assert license_scan(nothing).count() == 0 and license_scan(docs).where("n_licenses > 0").count() == 0


def test_license_scan_of_wrapped_and_cut_notices(spark):
    import textwrap

    from plumbline.llm.license_scan import NOTICES

    mit, gpl = NOTICES["mit"][2], NOTICES["gpl"][1]
    rows = [(1, "prose of a town\n\n" + textwrap.fill(mit, 72) + "\n\nmore prose"), (2, textwrap.fill(gpl, 75)), (3, " ".join(mit.split()[:14])), (4, "Permission to enter the building was granted\nby the guard at the gate free of charge to any person\nwho had a copy of the list")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].families for i in (1, 2, 3, 4)] == ["mit", "gpl", "mit", ""] and [got[i].n_licenses for i in (1, 2, 3, 4)] == [1, 1, 1, 0]


def test_language_model(docs, nothing):
    got = {r.doc_id: r for r in score_documents(docs, PIECES, frequent=20).collect()}
    rows = docs.collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in split(r.text))
    ends = sum(not held(r.doc_id) for r in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    less = min(max(once / (once + 2 * twice), 0.1), 0.9)
    p = train(docs.sparkSession.createDataFrame([(bytearray(x),) for x in counts], "word binary"), PIECES)
    own = lattice(PIECES)

    def pieces(x):  # the sum over all segmentations, by a recursion of its own
        s = MARK + x.decode()
        a = [1.0] + [0.0] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - own.longest), e):
                if (i := own.index.get(s[b:e])) is not None:
                    a[e] += a[b] * p[i]
                elif e - b == 1:
                    a[e] += a[b] * math.prod(p[own.bytes + c] for c in s[b:e].encode())
        return a[-1]

    of_word = functools.cache(lambda x: math.log10(max(counts[x] - less, 0) / n + less * v / n * pieces(x)))
    of_end = math.log10((ends - less) / n + less * v / n * p[own.end])
    for r in rows:
        w, g = split(r.text), got[r.doc_id]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert g.base_score == pytest.approx(base)
        assert g.score == pytest.approx(sum(of_word(x) for x in w) + of_end)
    assert score_documents(nothing, PIECES).count() == 0
    odd = docs.sparkSession.createDataFrame([(None, "a b", 1), (2, "a b", 1), (2, "a b", 1), (2, None, 1)], "doc_id long, text string, score long")
    assert sorted(r.n_tokens for r in score_documents(odd, PIECES).collect()) == [1, 3, 3, 3]
    held_only = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in score_documents(held_only, PIECES).collect())


def test_training_gains_from_each_round(spark):
    words = [b"the", b"there", b"then", b"theory", b"nation", b"national"]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")

    def likelihood(p):
        return float(lattice(PIECES).set(p).forward([MARK + w.decode() for w in words]).sum())

    by_rounds = [likelihood(train(df, PIECES, rounds=r)) for r in (1, 2, 3)]
    assert by_rounds == sorted(by_rounds) and likelihood(train(df, PIECES)) == pytest.approx(by_rounds[1])


def test_lattice_equals_the_sum_over_all_segmentations():
    import numpy as np

    from plumbline.llm.lm_scoring import MARK, Lattice

    own = Lattice(PIECES)
    p = own.first_weights()
    own.set(p)

    def total(s):
        a = [1.0] + [0.0] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - own.longest), e):
                i = own.index.get(s[b:e])
                if i is not None:
                    a[e] += a[b] * p[i]
                elif e - b == 1:
                    a[e] += a[b] * math.prod(p[own.bytes + c] for c in s[b:e].encode())
        return math.log(a[-1])

    tried = [MARK + w for w in ("the", "nation", "été", "日x", "a😀b", "abc" * 30, "x")]
    expect = np.zeros(own.size)
    assert own.forward(tried, expect) == pytest.approx([total(w) for w in tried])
    assert expect.sum() > len(tried)


def _shuffled(spark, run):
    """What ``run`` gives, and the records and bytes that it shuffles."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    given = run()
    new = [x for k, x in stages().items() if k not in before]
    return given, sum(r for r, _ in new), sum(b for _, b in new)


def test_substrings_leave_texts_without_factors_where_they_are(spark, monkeypatch):
    """Few texts of many share a passage: the others are not shuffled, whatever Spark would broadcast."""
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    words = lambda i, n: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(n))
    passage = words("shared", 60)
    rows = [(i, words(i, 200) + (f" {passage}" if i % 40 == 0 else "")) for i in range(400)] + [(None, words(0, 200)), (400, None), (401, words(7, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _, moved = _shuffled(spark, lambda: {r.doc_id: r for r in dedup_substrings(docs).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 0.6 * sum(len(t or "") for _, t in rows)
    assert {d: r.n_removed for d, r in got.items() if r.n_removed} == {i: 60 for i in range(40, 400, 40)} | {401: 200}
    assert len(got) == len(rows) and all(got[d].text == t for d, t in rows if d is None or not got[d].n_removed)


@pytest.mark.parametrize("sheets", [2048, 1])
def test_sieve_keeps_every_key(spark, sheets, monkeypatch):
    monkeypatch.setattr(_shared, "SHEETS", sheets)
    keys = spark.range(-3000, 9000, 3).unionByName(spark.range(5)).select(F.when(F.col("id") != 6, F.col("id")).alias("k"))
    rows = spark.range(-9000, 30000).select(F.when(F.col("id") != 0, F.col("id")).alias("id"))
    told = {r.id: r["__maybe"] for r in _shared.sifted(rows, F.col("id"), keys).collect()}
    among = {r.k for r in keys.collect()} - {None, 0}
    assert len(told) == 39000 and all(told[k] for k in among) and not told[None]
    assert sum(told.values()) - len(among) < (0.06 if sheets > 1 else 0.25) * 39000
    assert not any(r["__maybe"] for r in _shared.sifted(rows, F.col("id"), keys.where("k > 90000")).collect())


def test_quality_rules_shuffle_lines_once(spark):
    """Lines that few rows have are counted and go no further."""
    rows = [(i, "\n".join(f"line {i} {k} of a text" for k in range(40)) + "\nAll rights belong to us.", f"src{i % 2}") for i in range(100)]
    rows += [(100 + i, "again and again the same line\n" * 30, "src0") for i in range(2)] + [(200, "once more " * 9, "src1")] * 25
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).localCheckpoint()
    got, records, _ = _shuffled(spark, lambda: {r.doc_id: r for r in quality_rules(docs).collect()})
    assert records < 1.5 * 100 * 40
    assert {d for d, r in got.items() if r.n_line_words} == set(range(2, 100)) and all(got[d].n_line_words == 5 for d in range(2, 100))
