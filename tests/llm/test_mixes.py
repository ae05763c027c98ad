"""Centroid clustering, mixing to target weights and the filter audit: against their SQL and brute force, with odd rows."""

import hashlib
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest

from plumbline.llm import queries as llm
from plumbline.llm.centroid_clustering import cluster_report, delta_lloyd
from plumbline.llm.filter_audit import filter_audit, survivors
from plumbline.llm.source_mixing import mirrored, mix_documents, mixed_texts, mixing_sources, mixing_targets, sized_documents, slot_ranks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_source_mixing", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(llm.oracle_sql()[name])
    df = llm.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str) != []


def lloyd(rows, k, rounds, width, scale):
    """All vectors against all centroids, in every round."""
    kept = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), j) for j, q in enumerate(c))
    for _ in range(rounds):
        owned = {}
        for _, v in kept:
            owned.setdefault(near(v)[1], []).append(v)
        c = [tuple(sum(col) // len(owned[j]) for col in zip(*owned[j], strict=True)) if j in owned else q for j, q in enumerate(c)]
    return sorted((str(i), v, *near(v)[::-1]) for i, v in kept), c


@pytest.mark.parametrize(("k", "rounds"), [(5, 3), (5, 12), (1, 2), (90, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rng = random.Random(k + rounds)
    rows = [(i, [rng.choice([-1, 0, 0.3, 2]) + rng.random() for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1]), (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, float("nan"), 2.0, 3.0]), (105, [1.0, float("-inf"), 2.0, 3.0])]
    rows += [(200 + i, [0.5, -0.5, 0.25, 1.0]) for i in range(30)]  # a third of all rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, v int").repartition(5)
    want, centres = lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, rounds, 4, 8)
    got, c = delta_lloyd(df, k=k, rounds=rounds, width=4, scale=8)
    assert [tuple(x) for x in c.tolist()] == centres
    assert sorted((str(r.vec_id), tuple(r.v), r.cluster, r.distance) for r in got.collect()) == want
    report = cluster_report(got, c).collect()
    assert len(report) == len(want) and {r.inertia for r in report} == {sum(w[3] for w in want)}
    assert {(r.cluster, r.centroid_sha256) for r in report} <= {(j, hashlib.sha256(",".join(map(str, q)).encode()).hexdigest()) for j, q in enumerate(centres)}


def test_clusters_of_few_and_far_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2_000_000.0, -2_000_000.0])], "vec_id long, embedding array<double>")
    got, c = delta_lloyd(df, width=2)
    assert len(c) == 2 and sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0)]
    none, c = delta_lloyd(df.where("vec_id > 5"), width=2)
    assert none.count() == 0 and cluster_report(none, c).count() == 0
    with pytest.raises(Exception, match="no exact distances"):
        delta_lloyd(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), width=2)


def test_slot_ranks():
    for bits in (1, 4, 7):
        n = np.arange(1 << bits, dtype=np.int64)
        cell = mirrored(n, bits)
        assert sorted(cell) == list(n)
        for low in (0, 1, 3, (1 << bits) - 1, 1 << bits):
            assert list(slot_ranks(n, np.full_like(n, low), bits)) == [int((cell[:i] < low).sum()) for i in n]


def test_targets():
    def reshared(sizes, weights, most=3):
        """Shares that are cut and dealt again until none is above."""
        fixed = {}
        while True:
            free = [i for i in range(len(sizes)) if i not in fixed]
            rest = sum(sizes) - sum(fixed.values())
            share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
            over = [i for i in free if share[i] > most * sizes[i] * (1 + 1e-12)]
            if not over:
                return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
            fixed |= {i: most * sizes[i] for i in over}

    for sizes in ([10, 10, 10], [1, 1, 1000], [0, 5, 9], [0, 0, 0], [7], [100, 1, 2, 3, 4, 5, 1000]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert [a / b for a, b in mixing_targets(sizes, weights)] == pytest.approx(reshared(sizes, weights))
    assert mixing_targets([], []) == []


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(1000)}" for _ in range(n))
    rows = [(i, text(rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", "ü", None])) for i in range(200)]
    copy = text(9)
    rows += [(300 + i, copy, "a") for i in range(60)] + [(400, text(5000), "b"), (401, None, "b"), (402, "", "only empty"), (None, text(4), "a"), (None, text(4), "a"), (403, copy, "b"), (403, copy, "b"), (404, "one  two\tthree\n\n", "b"), (405, "x", "small")]
    return rows


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix(spark, mixed_rows, block):
    df = spark.createDataFrame([(*r, 5, "y") for r in mixed_rows], "doc_id long, text string, source string, size int, start string").repartition(6)
    per, schedule = mix_documents(df, block=block)
    rows, slots = per.collect(), schedule.orderBy("slot", "start").collect()
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(i), len((t or "").split())) for i, t, _ in mixed_rows)
    taken, target, size = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        size[r.source] = size.get(r.source, 0) + r["size"]
        target[r.source] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, s in mixed_rows if s == r.source)
    assert {s: int(x) for s, x in target.items()} == taken and sum(target.values()) == pytest.approx(sum(size.values()))
    assert target["small"] == 3 and target["only empty"] == 0
    # Whole words of slots are blocks, and every prefix of the mix is near the targets.
    by_slot = {}
    for r in slots:
        by_slot.setdefault(r.slot, []).append(r)
    assert all(len({(r.no, r.epoch) for r in v}) == 1 and sum(r["take"] for r in v) <= block for v in by_slot.values())
    words = {r["no"]: 0 for r in slots}
    names = sorted({s for _, _, s in mixed_rows if s is not None}) + [None]
    for i, slot in enumerate(sorted(by_slot), 1):
        for r in by_slot[slot]:
            words[r["no"]] += r["take"]
        for no, n in words.items():
            assert abs(n - target[names[no]] * i / len(by_slot)) <= 8 * block + 0.02 * target[names[no]]
    # What the slots read are the words of the documents.
    read = {r.slot: r.text for r in mixed_texts(df, schedule).collect()}
    assert {s: len(t.split()) for s, t in read.items()} == {s: sum(r["take"] for r in v) for s, v in by_slot.items()}
    known = {i: t.split() for i, t, _ in mixed_rows if i is not None and t}
    s, first = next((s, v[0]) for s, v in by_slot.items() if v[0].doc_id in known)
    assert read[s].split()[: first["take"]] == known[first.doc_id][first["skip"] : first["skip"] + first["take"]]
    again = mix_documents(df.repartition(2), block=block)[0]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_of_nothing(spark, mixed_rows):
    df = spark.createDataFrame(mixed_rows, "doc_id long, text string, source string")
    per, schedule = mix_documents(df.where("doc_id < 0"))
    assert per.count() == schedule.count() == 0
    per, schedule = mix_documents(df.where("doc_id = 402"))
    assert [(r["size"], r.target, r.taken) for r in per.collect()] == [(0, 0.0, 0)] and schedule.count() == 0
    assert mixing_sources(sized_documents(df, "doc_id", "text", "source"), block=10).orderBy("no").first().source == "a"


def audit(docs, labels):
    """Every order, document by document."""
    good, toxic = ({i for i, *q in labels if q[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, part in docs:
        w = (t or "").split()
        caps = sum("A" <= ch <= "Z" for ch in t or "")
        f = {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * caps > 10 * len(t or "") else set()
        f |= {"D"} if set(t or "") & set("#$%&*|") else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs) else set()
        fails.append((part or "", i, f))
    rows = []
    for part in {p for p, _, _ in fails}:
        mine, total = [(i, f) for p, i, f in fails if p == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                total[k] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), sum(k in f for _, f in mine) - len(gone), sum(f == {k} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        for r in rows:
            if r[0] == part:
                r.append(total[r[1][r[2] - 1]])
    return sorted(map(tuple, rows))


def test_audit_equals_every_order(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["Ab", "XYZ", f"w{rng.randrange(400)}", "c#", "é", "d" * rng.randrange(1, 4)]) if rng.random() < 0.5 else f"v{rng.randrange(10_000)}" for _ in range(rng.choice([5, 99, 100, 130])))
    texts = [text() for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(500 + i, texts[0], "en") for i in range(60)] + [(3, texts[0], "en"), (3, texts[0], "en"), (3, texts[0], "de"), (None, texts[0], "en"), (None, None, None), (None, "", "fr"), (601, None, "fr"), (602, "", "fr"), (603, "A" * 50_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, digest string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(df, lab)
    assert sorted(map(tuple, got.collect())) == audit(docs, labels)
    none = filter_audit(df.limit(0), lab)
    assert none.count() == 0 and none.columns == got.columns
    assert filter_audit(df, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_survivors():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, 32)
    assert [int(x) for x in survivors(counts)] == [sum(int(c) for m, c in enumerate(counts) if not m & s) for s in range(32)]
