"""Near-duplicate classes by DartMinHash signatures, banding, and exact weighted Jaccard similarity.

A text is a weighted set of 5-word shingles (weight: its count). Darts are thrown at the element's weight region: each unit
of weight receives a Poisson stream of darts, hashed from the element alone, each with a rank and one of K coordinates; a
set keeps the earliest dart of each coordinate. Only ranks below a bound that falls with the set's weight are looked at,
so a long text costs little more than one hash per shingle. Two sets agree in a coordinate with a probability equal to their
weighted Jaccard similarity. Bands of R coordinates make buckets; what shares a bucket is a candidate.

Buckets are never expanded into all pairs. Each member is first compared with its bucket's smallest member. Where that
leaves a bucket in several components, its members are compared inside tasks, only across components, and a task passes on
a spanning forest of the links it finds. Of a large bucket, what isn't of the main component is compared with each block of
it, and with its own kind in pairs of blocks: the work grows with the bucket times what the first comparison left over.
Every comparison that decides is exact.

A text is known by 64 bits of its hash. Texts of one such hash that a second hash and their sizes tell apart are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillscan.llm.components import components
from quillscan.llm.kernels import U, buffers, chunks, frugal, list_array, mix, shingle_cells, sorted_groups, uniform
from quillscan.session import broadcast_if_small, fresh, stored

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4: a pair at 0.8 shares no bucket with probability 3e-5, one at 0.9 with 2e-9.
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Members of a block in which a large bucket is compared.
BLOCK = 512
#: Cells that a task compares with at once; a longer text stands alone.
CELLS = 1 << 20
_STEP, _COORDINATE, _ID = 0xD1B54A32D192ED03, U(0x8CB92BA72F3D8DD7), U(0xABC98388FB8FAC03)


def dart_signatures(cells: np.ndarray, rows: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """For each of ``n`` rows the ids of the earliest darts of ``k`` coordinates; zeros for a row without cells.

    ``cells``: hashes of units of weight (see ``shingle_cells``), distinct within a row; ``rows``: ascending.
    """
    out = np.zeros((n, k), U)
    cells = cells.astype(np.int64).view(U)
    weight = np.bincount(rows, minlength=n)
    todo, bound = weight > 0, (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    while todo.any():
        mine = todo[rows]
        at, cell = rows[mine], cells[mine]
        rank = np.zeros(len(at))
        slots, ranks, ids = [], [], []
        step = 0
        while len(at):
            step += 1
            seed = cell + U(step * _STEP & 0xFFFFFFFFFFFFFFFF)
            rank = rank - np.log(uniform(mix(seed)))
            hit = rank < bound[at]
            at, cell, rank, seed = at[hit], cell[hit], rank[hit], seed[hit]
            slots.append(at * k + (mix(seed + _COORDINATE) % U(k)).astype(np.int64))
            ranks.append(rank)
            ids.append(mix(seed + _ID))
        slot, rank, ids_ = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, slot, rank)
        best = rank == first[slot]
        flat = out.reshape(-1)
        flat[slot[best]] = ids_[best]
        todo = todo & np.isinf(first.reshape(n, k)).any(axis=1)  # a coordinate without a dart: look further
        bound = bound * 2
    return out


@frugal
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, bands; texts without words are left out."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            cells, rows = shingle_cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            good = np.flatnonzero(np.bincount(rows, minlength=j - i))
            if not len(good):
                continue
            sig = dart_signatures(cells, rows, j - i)[good]
            band = np.zeros((len(good), BANDS), U)
            for r in range(ROWS):
                band = mix(band * U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            band = mix(band + np.arange(BANDS, dtype=U) * U(0xC2B2AE3D27D4EB4F)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good + i)), list_array(band.reshape(-1), np.full(len(good), BANDS), pa.int64())], ["node", "bands"])


@frugal
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            cells, rows = shingle_cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(cells, np.bincount(rows, minlength=j - i), pa.int64())], ["node", "cells"])


@frugal
def _sorted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, cells (eight bytes each, sorted)."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            cells, rows = shingle_cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            cuts = np.searchsorted(rows, np.arange(1, j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.sort(x).astype("<i8").tobytes() for x in np.split(cells, cuts)], pa.binary())], ["node", "cells"])


@frugal
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (block, side, node, label, cells), sorted by block -> links (a, b) across labels, as a forest.

    Sides 0 and 1 are two blocks of a bucket, 2 a block against itself. The comparison is exact, as in ``_verified``: a
    pair is skipped only where links that hold have joined it already.
    """

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        side, node, label = (t.column(c).to_numpy() for c in ("side", "node", "label"))
        cells = [np.frombuffer(x, "<i8") for x in t.column("cells").to_pylist()]
        size = np.array([len(x) for x in cells])
        _, root = np.unique(label, return_inverse=True)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        pairs = []
        ends = np.concatenate(([0], np.cumsum(size[right])))
        for first, last in chunks(ends, CELLS):
            part = right[first:last]
            known, place = np.unique(np.concatenate([cells[x] for x in part]), return_inverse=True)
            at, mark = ends[first:last] - ends[first], np.zeros(len(known), bool)
            for i in left:
                # sizes bound the similarity: the smaller over the larger
                near = (root[part] != root[i]) & (np.minimum(size[part], size[i]) >= SIMILARITY * np.maximum(size[part], size[i]) - 1e-9)
                if not near.any():
                    continue
                k = np.minimum(np.searchsorted(known, cells[i]), len(known) - 1)
                k = k[known[k] == cells[i]]
                mark[k] = True
                common = np.add.reduceat(mark[place], at, dtype=np.int64)
                mark[k] = False
                for x in part[near & (common >= SIMILARITY * (size[i] + size[part] - common) - 1e-9)]:
                    if root[x] != root[i]:
                        pairs.append((min(node[i], node[x]), max(node[i], node[x])))
                        root[root == root[x]] = root[i]
        if pairs:
            x, y = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        return None

    for t in sorted_groups(batches):
        if out := compare(t):
            yield out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity is at least 0.8, by ``texts`` (node, text)."""
    pairs = stored(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    cells = stored(texts.join(wanted, F.col("node") == F.col("want"), "left_semi").select("node", "text").mapInArrow(_cells, "node long, cells array<long>"))
    left, right = (cells.select(F.col("node").alias(f"node_{x}"), F.col("cells").alias(f"cells_{x}")) for x in "ab")
    joined = pairs.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b"))
    common = F.size(F.array_intersect("cells_a", "cells_b"))
    return joined.select("a", "b", common.alias("common"), F.size("cells_a").alias("na"), F.size("cells_b").alias("nb")).where(f"common >= {SIMILARITY} * (na + nb - common) - 1e-9 AND common > 0").select("a", "b")


def links(docs: DataFrame) -> DataFrame:
    """(node: 64 bits of a text, label): components of near copies."""
    nodes = docs.select("doc_id", _node(docs).alias("node"), "text")
    # copies sign alike, and what groups them below counts each node once: no text moves here
    signed = nodes.select("node", "text").mapInArrow(_sign, "node long, bands array<long>")
    members = stored(signed.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node").distinct())
    buckets = members.groupBy(F.col("bucket").alias("of")).agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    shared = stored(members.join(buckets, F.col("bucket") == F.col("of")).select("bucket", "node", "leader"))

    # one row of each text that shares a bucket: the only time that texts move
    first = nodes.groupBy(F.col("node").alias("of")).agg(F.min("doc_id").alias("first"))
    first = first.join(shared.select("node").distinct(), F.col("of") == F.col("node"), "left_semi")
    texts = stored(nodes.join(first, F.expr("node = of AND doc_id <=> first"), "left_semi").select("node", "text"))
    edges = stored(_verified(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), texts))
    labels = components(edges)

    # buckets that still hold several components
    placed = stored(shared.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", F.coalesce("label", "node").alias("label")))
    by_label = placed.groupBy(F.col("bucket").alias("of"), "label").agg(F.count("*").alias("mine"))
    keys = by_label.groupBy("of").agg(F.sum("mine").alias("n"), F.max(F.struct("mine", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1 AND n > 2")
    few = F.col("n") <= BLOCK
    main = ~few & (F.col("label") == F.col("most.label"))
    rest, parts = F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("most.mine")) / BLOCK)).cast("int"), F.when(few, 0).otherwise(F.ceil(F.col("most.mine") / BLOCK)).cast("int")
    open_ = placed.join(keys, F.col("bucket") == F.col("of")).select("bucket", "node", "label", main.alias("main"), rest.alias("rest"), parts.alias("parts"))
    # blocks of the rest come first, then those of the main component, which aren't compared with each other
    h = F.xxhash64("node", F.lit(1))
    open_ = stored(open_.withColumn("mine", F.when(F.col("main"), F.col("rest") + F.pmod(h, F.greatest("parts", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))).cast("int")))
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("main"), 0).otherwise(F.col("parts")))))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), side.alias("side"), "node", "label")
    wanted = open_.select(F.col("node").alias("want")).distinct()
    sketches = stored(texts.join(wanted, F.col("node") == F.col("want"), "left_semi").select(F.col("node"), "text").mapInArrow(_sorted_cells, "node long, cells binary").withColumnRenamed("node", "of"))
    dealt = dealt.join(sketches, F.col("node") == F.col("of")).select("block", "side", "node", "label", "cells")
    more = stored(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_compare, "a long, b long").distinct())
    if more.limit(1).count():
        labels = components(edges.union(more))
    return labels


def _node(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label) of all rows of ``docs``: rows of one label are near copies.

    Where texts of one node have several checks (a second hash and their sizes), those with other than the smallest stand
    alone.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    check = F.xxhash64(F.hash(text), F.octet_length(text))
    nodes = docs.select("doc_id", _node(docs).alias("node"), check.alias("check"))
    clashes = stored(nodes.groupBy(F.col("node").alias("clash")).agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least < most").select("clash", "least"))
    labels = links(docs).withColumnRenamed("node", "of")
    joined = nodes.join(broadcast_if_small(clashes), F.col("node") == F.col("clash"), "left").join(labels, F.col("node") == F.col("of"), "left")
    return joined.select("doc_id", "node", F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.coalesce("label", "node")).alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id, kept.

    class_id is the smallest doc_id among texts that are linked, directly or in a chain, by a similarity of 0.8 or more of
    their 5-word shingles (fewer words: of all words at once); equal texts are of one class. A null text is an empty one;
    texts without words are of one class only if equal. Rows with a null doc_id count, but don't give a class its id
    unless all are null. kept: doc_id is class_id (null: true). Repeated rows are returned as often as they occur.
    """
    placed = stored(labelled(docs).select("doc_id", "label"))
    classes = stored(placed.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("class_id")))
    return placed.join(classes, F.col("label") == F.col("of")).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id (null ids last; of repeated rows any one)."""
    rows = labelled(docs).groupBy("label", "doc_id", "node").agg(F.count("*").alias("n"))
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("best")).select("best.doc_id", "best.node", "best.n")
    of, node, n = (fresh(x, docs.columns) for x in ("best_id", "best_node", "best_n"))
    best = stored(best.toDF(of, node, n))
    hashed = _node(docs)

    def kept(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[of]) & (hashed == chosen[node]), "left_semi")

    repeated = best.where(best[n] > 1)
    once = kept(best.where(best[n] == 1))
    if not repeated.limit(1).count():
        return once
    # rows that repeat an id and its text may differ in other columns: one of them, by all columns' hash
    some = kept(repeated)
    rank, h = fresh("rank", docs.columns), F.xxhash64(*(docs[c] for c in docs.columns))
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return once.union(some.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(h))).where(f"{rank} = 1").drop(rank))
