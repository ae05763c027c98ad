"""N-gram Jaccard join: a metric-space join with pivots, exact at a similarity of 0.8.

1 - Jaccard is a metric. The join works on the distinct shingle sets (nodes),
so copies of a text are one point. Most sets of a corpus are at distance 1 from
each other, where the triangle inequality says nothing: Voronoi cells of pivots
drawn from the data would have to replicate such a set to every cell (README
has the measured share). So the first level is another exact one, and pivots
and windows work inside it.

Cells. All shingles have one global order, rare ones first (by a count sketch
of fixed size over all documents). Sets within 0.2 of each other share one of
the first |X| - ceil(4|X|/5) + 1 shingles of either, so a set is replicated to
the cells of those, and the first shingle that two linked sets have in common
leaves both long enough a rest to reach the overlap that their sizes ask for:
pairs whose rest is too short in a cell are none there.

Regions. A cell's pivot is the node of its first document. A node is compared
with one pivot, its home: the one it shares most cells with. That is linear in
the nodes, however many near copies there are. Nodes that this links are one
class from then on.

Recursion. Cells whose nodes are all of one class are done. In those left, each
node outside a cell's main class meets one member of such a class, and classes
join; after some rounds of this, which are linear as well, all nodes of
different classes that are still in one cell meet, if sizes, rests and, for
nodes of one home, the triangle window (their distances to it differ by 0.2 at
most) allow a link.

Before a pair is compared in full, the signatures of its sets (how many
shingles fall into each of 128 bins) bound what they can have in common; a pair
whose bound is below the threshold is no link, for certain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, by_keys, keep, prepare
from .wordhash import run_hashes, word_hashes

SHINGLE = 5
#: Stands for a null id where the smallest is looked for.
LAST = (1 << 63) - 1
#: Counters of the sketch, four bytes each, whatever the corpus.
COUNTERS = 1 << 20
#: Rounds in which each node outside the main class of its cells meets one of that class, before all pairs that are left do.
TRIES = 4
#: Counters that travel as one row.
BLOCK = 1 << 14
#: A region whose shingle counts above this share of the mean count per counter (and this number) is dealt over SALTS tasks.
HOT_TIMES, HOT_LEAST, SALTS = 4, 2_000, 32


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(shingle, len(words))))


#: Bins of a signature, of a byte each.
BINS = 128


def _signature(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each bin; None if a count does not fit."""
    counts = np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _scan(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document (doc_id, key, n, node, sig); per task rows (block, sketch) with its packed counters."""
    names = ["doc_id", "key", "n", "node", "sig", "block", "sketch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, nodes, signatures, pending = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), shingle)
                sizes.append(len(s))
                nodes.append(_node(s))
                signatures.append(_signature(s))
                pending.append(s)
            if pending:
                counts += np.bincount((np.concatenate(pending) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            own = [pa.array(x, k) for x, k in zip((sizes, nodes, signatures), kinds[2:5])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own, *(pa.nulls(len(nodes), k) for k in kinds[5:])], names=names)
        blocks = [(k, _pack(counts[k * BLOCK : (k + 1) * BLOCK])) for k in range(COUNTERS // BLOCK) if counts[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(blocks), k) for k in kinds[:5]), pa.array([k for k, _ in blocks], kinds[5]), pa.array([x for _, x in blocks], kinds[6])], names=names)

    given = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return given.mapInArrow(run, "doc_id long, key long, n long, node long, sig binary, block int, sketch binary")


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)


def _add_sketches(rows: DataFrame) -> bytes:
    """The sum of all tasks' sketches: blocks of counters are added by their number, in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block] = total.get(block, 0) + _unpack(packed.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_pack(x) for x in total.values()], pa.binary())], names=["block", "sketch"])

    added = rows.where(F.col("block").isNotNull()).select("block", "sketch").repartition("block").mapInArrow(run, "block int, sketch binary")
    total = np.zeros(COUNTERS, np.int64)
    for r in added.collect():  # COUNTERS / BLOCK rows
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = _unpack(r.sketch)
    return _pack(total)


def _regions(docs: DataFrame, sketch: bytes, shingle: int) -> DataFrame:
    """(cell, salt, doc_id, node, n, pos): each set in the cells of its prefix; pos counts the shingles before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _unpack(shared.value)
        hot = max(HOT_LEAST, HOT_TIMES * int(counts.mean()))
        for batch in batches:
            parts: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(t.as_py(), shingle)
                n = len(s)
                if not n:
                    continue
                node = _node(s)
                often = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: n - (4 * n + 4) // 5 + 1]
                salt = np.where(often[first] > hot, 1 + node % SALTS, 0).astype(np.int32)
                k = len(first)
                parts.append((s[first].view(np.int64), salt, np.full(k, LAST if d is None else d, np.int64), np.full(k, node, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["cell", "salt", "doc_id", "node", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "cell long, salt int, doc_id long, node long, n int, pos int")


def _met(rows: DataFrame) -> DataFrame:
    """(cell, salt, node, n, pos, pivot, pn, ppos): rows of regions with two nodes or more, with the first document's node as pivot.

    ``rows`` come sorted by cell, salt and document: what later documents were
    made of is often the earliest. A node can come up again for copies. Hot
    regions, which are dealt over several keys, stay also where one key has a
    single node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the region that the batch before ended in
        last = None  # that region's last node
        alone = False  # whether that region has only one node so far
        names = ["cell", "salt", "node", "n", "pos", "pivot", "pn", "ppos"]
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, salt, node, n, pos = (batch.column(k).to_numpy() for k in range(5))
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])
            differs = np.ones(len(cell), bool)
            differs[1:] = node[1:] != node[:-1]
            if held is not None and (cell[0], salt[0]) == held[:2]:
                new[0] = False
                differs[0] = node[0] != last
            take = new | differs
            cell, salt, node, n, pos, new = (x[take] for x in (cell, salt, node, n, pos, new))
            if not len(cell):
                continue
            if held is not None and not new[0]:  # goes on
                lead = held
                if alone:
                    cell, salt, node, n, pos = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, (cell, salt, node, n, pos)))
                    new = np.concatenate([[True], new])
            else:
                lead = None
            start = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: the region that goes on and was met before
            sizes = np.bincount(group, minlength=group[-1] + 1)
            ends = len(start) and sizes[group[-1]] == 1
            pivot, pn, ppos = (np.concatenate([[lead[k] if lead is not None else 0], x[start]]).astype(x.dtype)[group] for k, x in ((2, node), (3, n), (4, pos)))
            out = (sizes[group] > 1) | (group == 0) | (salt > 0)
            if ends and salt[-1] == 0:
                out[-1] = False
            held = tuple(x[start[-1]] for x in (cell, salt, node, n, pos)) if len(start) else lead
            alone = bool(ends and salt[-1] == 0)
            last = node[-1]
            # Copies of a node in one region: the first of the batch will do.
            order = np.lexsort((np.arange(len(node)), node, group))
            again = (node[order][1:] == node[order][:-1]) & (group[order][1:] == group[order][:-1])
            out[order[1:][again]] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (cell, salt, node, n, pos, pivot, pn, ppos)], names=names)

    return rows.mapInArrow(run, "cell long, salt int, node long, n int, pos int, pivot long, pn int, ppos int")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, set): the shingles of each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            if sets:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), lists], names=["node", "set"])

    return docs.select("text").mapInArrow(run, "node long, set array<long>")


def _sets_of(tables: Tables, pairs: DataFrame, first: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The sets of the nodes of ``pairs``, each from its first document's text."""
    wanted = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    wanted = tables.keep(wanted.join(first.select("node", "doc_id"), "node").select("doc_id").distinct())
    texts = by_keys(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))), wanted, ["doc_id"], "left_semi")
    sets = tables.keep(_sets(texts, shingle).dropDuplicates(["node"]))
    tables.drop(wanted)
    return sets


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, union) of each pair, over whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).cast("long").alias("total")).select("a", "b", "common", (F.col("total") - F.col("common")).alias("union"))


def _possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures allow a similarity of 0.8: common shingles of 4/9 of both sizes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = batch.column(4), batch.column(5)
            known = np.array([u.is_valid and v.is_valid for u, v in zip(x, y)], bool)
            table = [np.frombuffer(b"".join(v.as_py() if k else bytes(BINS) for v, k in zip(c, known)), np.uint8).reshape(-1, BINS) for c in (x, y)]
            bound = np.minimum(*table).sum(1, dtype=np.int64)
            keeps = pa.array(~known | (9 * bound >= 4 * sized))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keeps) for k in (0, 1)], names=["a", "b"])

    left = signatures.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
    right = signatures.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _allowed(n, i, m, j):
    """Whether sets of sizes n and m whose first common shingle is their i-th and j-th can have a similarity of 0.8."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


def classes(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that links (a, b) reach, for each node of a link; one of ``tables``.

    Every round a node takes the smallest class among its own and its
    neighbours' and then its class's class, until nothing changes.
    """
    either = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    both = tables.keep(links.select(either.alias("e")).select("e.*").where("node != to").distinct())
    labels = tables.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("class")))
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "class"), "to").groupBy("node").agg(F.min("class").alias("near"))
        step = labels.select("node", "class").join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = step.select(F.col("node").alias("class"), F.col("class").alias("up"))
        before, labels = labels, tables.keep(step.join(jump, "class", "left").select("node", F.coalesce("up", "class").alias("class"), F.col("old")))
        tables.drop(before)
        if not labels.where("class != old").limit(1).count():
            tables.drop(both)
            return labels


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("100 * common >= 80 * union").select("a", "b")


def _links(tables: Tables, docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node) per document, and the links (a, b) that make the classes of nodes."""
    scanned = tables.keep(_scan(docs, shingle))
    of_docs = scanned.where(F.col("node").isNotNull()).select("doc_id", "key", "n", "node")
    dealt = _regions(docs, _add_sketches(scanned), shingle).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "doc_id", "node")
    met = tables.keep(_met(dealt.select("cell", "salt", "node", "n", "pos")))

    # Hot cells are several keys; their pivots meet the smallest of them.
    hot = met.where("salt > 0")
    heads = hot.groupBy("cell").agg(F.min(F.struct("pivot", "pn", "ppos")).alias("h")).select("cell", "h.*")
    to_heads = hot.select("cell", F.col("pivot").alias("node"), F.col("pn").alias("n"), F.col("ppos").alias("pos")).distinct().join(heads, "cell")
    names = ["node", "n", "pos", "pivot", "pn", "ppos"]
    star = met.select(names).unionByName(to_heads.select(names)).where((F.col("pivot") != F.col("node")) & _allowed(*map(F.col, ("n", "pos", "pn", "ppos"))))
    star = star.groupBy("node", "pivot").agg(F.count("*").alias("cells")).groupBy("node").agg(F.max_by("pivot", F.struct("cells", -F.col("pivot"))).alias("home"))
    star = star.select(F.col("node").alias("a"), F.col("home").alias("b"))

    first = scanned.where("n > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc_id"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    first = tables.keep(first)
    possible = tables.keep(_possible(star, first))
    sets = _sets_of(tables, possible, first, docs, shingle)
    compared = tables.keep(_compare(possible, sets))
    tables.drop(sets, possible)
    labels = classes(tables, _linked(compared)).select("node", "class")

    # What is left: cells whose nodes are in several classes.
    homes = compared.select(F.col("a").alias("node"), F.col("b").alias("home"), (1 - F.col("common") / F.col("union")).alias("far"))
    about = labels.join(homes, "node", "full_outer")
    classed = tables.keep(met.select("cell", "node", "n", "pos").join(about, "node", "left").withColumn("class", F.coalesce("class", "node")).distinct())
    tables.drop(met)
    left = tables.keep(_opened(classed))
    tables.drop(classed)
    links = _linked(compared)
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for k in range(TRIES):
        pairs = _one_pair_each(left, k).join(done, ["a", "b"], "left_anti")
        possible = tables.keep(_possible(pairs, first))
        sets = _sets_of(tables, possible, first, docs, shingle)
        compared = tables.keep(_compare(possible, sets))
        tables.drop(sets, possible)
        found = _linked(compared)
        if not found.limit(1).count():
            break
        links, done = links.unionByName(found), done.unionByName(compared.select("a", "b"))
        class_of = left.select("node", "class").distinct()
        between = found.join(class_of.toDF("a", "ca"), "a").join(class_of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = classes(tables, between)
        joined = merged.select(F.col("node").alias("class"), F.col("class").alias("into"))
        before, left = left, tables.keep(_opened(by_keys(left.drop("main"), joined, ["class"], "left").withColumn("class", F.coalesce("into", "class")).drop("into")))
        tables.drop(before, merged)

    small = _can_be_smaller()
    x = left.where(small).select(*(F.col(c).alias(f"x_{c}") for c in left.columns))
    y = left.select(*(F.col(c).alias(f"y_{c}") for c in left.columns))
    window = F.coalesce((F.col("x_home") != F.col("y_home")) | (F.abs(F.col("x_far") - F.col("y_far")) <= 0.2000001), F.lit(True))
    meets = (F.col("x_cell") == F.col("y_cell")) & (F.col("x_class") != F.col("y_class")) & (F.col("x_n") <= F.col("y_n")) & window & _allowed(*map(F.col, ("x_n", "x_pos", "y_n", "y_pos")))
    others = x.join(y.where("y_class != y_main"), meets).unionByName(x.where("x_class != x_main").join(y.where("y_class = y_main"), meets))
    pairs = others.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    possible = tables.keep(_possible(pairs.join(done, ["a", "b"], "left_anti"), first))
    tables.drop(left)
    more = _linked(_compare(possible, _sets_of(tables, possible, first, docs, shingle)))
    return of_docs, links.unionByName(more)


def _can_be_smaller():
    """Whether a row's set can be the smaller one of a link whose first common shingle is the cell's."""
    return 9 * (F.col("n") - F.col("pos")) >= 8 * F.col("n")


def _opened(classed: DataFrame) -> DataFrame:
    """The rows of cells with several classes, with ``main``, the class of most nodes."""
    per = classed.groupBy("cell", "class").agg(F.count("*").alias("k"), F.max(_can_be_smaller()).alias("small"))
    cells = per.groupBy("cell").agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.count("*").alias("classes"), F.max("small").alias("small"))
    return classed.join(cells.where("classes > 1 and small").select("cell", "main"), "cell")


def _one_pair_each(left: DataFrame, k: int) -> DataFrame:
    """(a, b): of each node outside its cells' main class one pair, with the member of those classes that it meets in most cells.

    A cell's member is the one with the fewest rare shingles before the cell's
    (which others of its class are likely to be near), or any, by a hash.
    """
    order = F.struct("pos", "node") if k == 0 else F.struct(F.xxhash64(F.lit(k), "node"), "node")
    member = left.where("class = main").groupBy("cell").agg(F.min_by(F.struct("node", "n", "pos"), order).alias("m"))
    met = left.where("class != main").join(member.select("cell", F.col("m.node").alias("b"), F.col("m.n").alias("m"), F.col("m.pos").alias("j")), "cell")
    met = met.where(_allowed(F.col("n"), F.col("pos"), F.col("m"), F.col("j"))).groupBy("node", "b").agg(F.count("*").alias("cells"))
    best = met.groupBy("node").agg(F.max_by("b", F.struct("cells", "b")).alias("b"))
    return best.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _members(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, key, n, class, smallest, head) per document: of classes of several documents, the smallest id and the first document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Tables(spark) as tables:
        of_docs, links = _links(tables, docs, shingle)
        labels = classes(tables, links).select("node", "class")
        member = keep(of_docs.join(labels, "node", "left").select("doc_id", "key", "n", F.coalesce("class", "node").alias("class")))
    known = F.col("doc_id").isNotNull()
    head = F.min(F.when(known, F.struct("doc_id", "key")))
    several = member.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"), head.alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    return member.join(several, "class", "left")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the size of its shingle set and the smallest id that links reach.

    Two documents link if 100 * common >= 80 * union of their sets of distinct
    shingles of five words (A-Z lower case). Texts with fewer words are one
    shingle; null and empty texts have none and link with nothing, each being
    a class of its own. Repeated rows and copies are in one class. A null id
    stays null and represents a class only if no other id is in it. Other
    columns of ``docs`` are not returned.
    """
    own = F.when(F.col("n") > 0, F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id"))
    return _members(docs, doc_id, text, shingle).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def near_duplicates_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id.

    Rows of one id and text are one document, and stay or go together; of
    several texts with the smallest id, one stays. Documents without words and
    rows without an id all stay. All columns of ``docs`` are returned.
    """
    member = _members(docs, doc_id, text, SHINGLE)
    gone = member.where((F.col("n") > 0) & F.col("doc_id").isNotNull() & (F.struct("doc_id", "key") != F.col("head")))
    gone = keep(gone.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct())
    return by_keys(docs, gone, (docs[doc_id].cast("long") == gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__key"]), "left_anti")
