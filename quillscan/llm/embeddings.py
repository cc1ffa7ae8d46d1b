"""Exact embedding near-duplicates by cover trees and a dual traversal.

Vectors of one label are dealt to cells around pivots (a bounded sample), cells to chunks of a bounded size. Each chunk gets a
cover tree: nested levels whose radii halve, down to a radius below which nodes are searched point by point. Two chunks
are searched together by a dual traversal: a pair of nodes is dropped once the distance of their centres exceeds both
covering radii and the link distance; what is left at the last level is compared exactly. Chunk pairs whose cells are
too far apart are never made. A hot label is many chunks, hence many tasks; links are counted and reduced to a spanning
forest inside the task, never emitted one by one.

The number of chunk pairs of a label grows with its square where its cells can't be told apart (as with random vectors);
that is inherent in an exact join without a bound on its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.components import components
from quillscan.llm.kernels import sorted_groups
from quillscan.session import broadcast_if_small, stored

COSINE = 0.93
#: Vectors of a chunk: a task holds two. Each vector goes to as many tasks as there are chunks near it, so larger chunks are
#: copied less often.
CHUNK = 4096
#: Vectors whose distances to others are in memory at once.
TILE = 1024
#: Pivots altogether; labels of over CHUNK vectors share them by their sizes.
PIVOTS = 1024
#: Covering radii of the tree's levels, for unit vectors; a root covers all.
LEVELS = (1.0, 0.5, 0.25)


def cover_tree(x: np.ndarray) -> np.ndarray:
    """For unit vectors: the centre (a row of ``x``) of the node that holds each row, by level (rows x levels).

    Each level refines the one before: a node of the level above is divided into nodes of the level's radius, its own
    centre being the first of them; further centres are the points farthest from all so far.
    """
    n = len(x)
    out = np.zeros((n, len(LEVELS)), np.int32)
    groups: list[tuple[int, np.ndarray]] = [(0, np.arange(n))] if n else []
    for level, radius in enumerate(LEVELS):
        finer = []
        for centre, members in groups:
            points = x[members]
            near = 2.0 - 2.0 * (points @ x[centre])  # squared distances
            of = np.full(len(members), centre)
            while len(members) > 1:
                far = int(near.argmax())
                if near[far] <= radius * radius:
                    break
                new = members[far]
                d = 2.0 - 2.0 * (points @ x[new])
                d[far] = 0.0
                closer = d < near
                of[closer] = new
                near[closer] = d[closer]
            out[members, level] = of
            if (of == centre).all():
                finer.append((centre, members))
            else:
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                finer += [(int(of[part[0]]), members[part]) for part in np.split(order, cuts)]
        groups = finer
    return out


class _Tree:
    """A chunk's tree with tight covering radii, from the centres that each row carries."""

    def __init__(self, x: np.ndarray, centres: np.ndarray, local: np.ndarray) -> None:
        self.levels = []
        size = 0
        place = np.empty(int(local.max()) + 1, np.int64)
        place[local] = np.arange(len(local))
        for k in range(centres.shape[1]):
            nodes, of = np.unique(place[centres[:, k]], return_inverse=True)
            if len(nodes) == size:  # nothing was divided at this level
                continue
            size = len(nodes)
            d2 = np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, x[nodes][of]))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, of, np.sqrt(d2))
            radius[radius < 1e-7] = 0.0
            self.levels.append((nodes, of, radius))


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.tolist(), b.tolist()
    return math.fsum(p * q for p, q in zip(a, b)) / math.sqrt(math.fsum(p * p for p in a) * math.fsum(q * q for q in b))


def dual_links(xa: np.ndarray, ta: _Tree, xb: np.ndarray, tb: _Tree, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of a, row of b) whose cosine is at least ``cosine``."""
    reach = math.sqrt(2.0 - 2.0 * cosine) + 1e-6
    alive_a, alive_b, mask = np.arange(len(xa)), np.arange(len(xb)), None
    last_a = last_b = None
    for k in range(max(len(ta.levels), len(tb.levels))):
        na, oa, ra = ta.levels[min(k, len(ta.levels) - 1)]
        nb, ob, rb = tb.levels[min(k, len(tb.levels) - 1)]
        d2 = 2.0 - 2.0 * (xa[na] @ xb[nb].T)
        bound = ra[:, None] + rb[None, :] + reach
        near = d2 <= bound * bound
        if mask is not None:  # children of dropped pairs stay dropped
            near &= mask[np.ix_(last_a[na], last_b[nb])]
        mask, last_a, last_b = near, oa, ob
        if not near.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if mask is not None:
        alive_a = np.flatnonzero(mask.any(axis=1)[last_a])
        alive_b = np.flatnonzero(mask.any(axis=0)[last_b])
    norm_a, norm_b = (np.sqrt((r**2).sum(axis=1)) for r in (raw_a[alive_a], raw_b[alive_b]))
    found_a, found_b = [], []
    for k in range(0, len(alive_a), TILE):
        rows = alive_a[k : k + TILE]
        g = raw_a[rows] @ raw_b[alive_b].T
        g /= norm_a[k : k + TILE, None] * norm_b[None, :]
        if mask is not None:
            g[~mask[np.ix_(last_a[rows], last_b[alive_b])]] = -2.0
        i, j = np.nonzero(g >= cosine - 1e-12)
        good = np.ones(len(i), bool)
        for c in np.flatnonzero(g[i, j] < cosine + 1e-12):  # rounding could decide: in exact sums
            good[c] = _exact(raw_a[rows[i[c]]], raw_b[alive_b[j[c]]]) >= cosine
        found_a.append(rows[i[good]])
        found_b.append(alive_b[j[good]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect the same nodes as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, uid, cell, vector -> the same, local (row in the chunk) and centres (of its nodes, by level)."""
    for t in sorted_groups(batches):
        t = t.combine_chunks()
        centres = cover_tree(_unit(_matrix(t.column("vector"))))
        n = len(centres)
        ends = pa.array(np.arange(n + 1) * len(LEVELS), pa.int32())
        rows = t.append_column("local", pa.array(np.arange(n), pa.int32())).append_column("centres", pa.ListArray.from_arrays(ends, pa.array(centres.reshape(-1), pa.int32())))
        yield from rows.to_batches()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """task, side, uid, vector, local, centres -> counts (uid, n) and edges (uid, other)."""

    for t in sorted_groups(batches):
        side = t.column("side").to_numpy()
        parts = []
        for s in (0, 1) if (side != 2).any() else (2, 2):
            part = t.filter(pa.array(side == s))
            if not len(part):
                break
            raw = _matrix(part.column("vector"))
            x = _unit(raw)
            uid, local = part.column("uid").to_numpy(), part.column("local").to_numpy()
            parts.append((uid, raw, x, _Tree(x, _matrix(part.column("centres")).astype(np.int64), local)))
        if len(parts) < 2:
            continue
        (ua, ra, xa, ta), (ub, rb, xb, tb) = parts
        i, j = dual_links(xa, ta, xb, tb, ra, rb)
        a, b = ua[i], ub[j]
        if (side == 2).any():
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        nodes, n = np.unique(np.concatenate((a, b)), return_counts=True)
        root, node = forest(a, b)
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), none, pa.array(n, pa.int64())], ["uid", "other", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node), pa.nulls(len(node), pa.int64())], ["uid", "other", "n"])


def _nearest(pivots: dict[tuple, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """uid, label, vector -> uid, label, cell (row of its label's nearest pivot; null without pivots), distance, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, far = np.full(n, -1, np.int64), np.zeros(n)
            labels = np.array(batch.column(1).to_pylist(), object)
            size = batch.column(2).value_lengths().to_numpy() if n else np.zeros(0, int)
            for (label, dim), (ids, p) in pivots.items():
                rows = np.flatnonzero((labels == label) & (size == dim))
                if len(rows):
                    x = _unit(_matrix(batch.column(2).take(pa.array(rows))))
                    d2 = np.maximum(0.0, 2.0 - 2.0 * (x @ p.T))
                    best = d2.argmin(axis=1)
                    cell[rows], far[rows] = ids[best], np.sqrt(d2[np.arange(len(rows)), best])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, mask=cell < 0), pa.array(far), batch.column(2)], ["uid", "label", "cell", "distance", "vector"])

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Links: equal labels that aren't null, equal dimensions, cosine >= 0.93 in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Repeated rows are vectors of their own, which
    link with each other. component_id: the smallest vec_id reachable (null ids aside); kept: vec_id = component_id (also
    where both are null).
    """
    spark = vectors.sparkSession
    if cosine != COSINE:
        raise ValueError("the kernels are built for one threshold")
    kind = vectors.schema["label"].dataType.simpleString()
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select("uid", "label", "vector")

    # pivots, for labels of more than a chunk
    sizes = good.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("size"))
    big = stored(sizes.where(F.col("size") > chunk))
    wanted = min(pivots, big.agg(F.sum(F.ceil(F.col("size") / chunk))).first()[0] or 0)
    found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    if wanted:
        candidates = good.withColumn("dim", F.size("vector")).join(big, ["label", "dim"], "left_semi")
        picked = candidates.orderBy(F.xxhash64("uid"), "uid").limit(int(wanted)).collect()
        for key in sorted({(r.label, r.dim) for r in picked}):
            mine = [r for r in picked if (r.label, r.dim) == key]
            found[key] = (np.array([r.uid for r in mine]), _unit(np.array([r.vector for r in mine], np.float64)))
    placed = good.mapInArrow(_nearest(found), f"uid long, label {kind}, cell long, distance double, vector array<double>")
    placed = stored(placed.select("uid", F.xxhash64("label", F.size("vector"), "cell").alias("cell"), F.col("cell").alias("pivot"), "distance", "vector"))

    # cells that may hold links with each other, and how many chunks each has
    cells = placed.groupBy("cell", "pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).select("cell", "pivot", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), "radius")
    cells = stored(cells)
    alone = cells.where("pivot IS NULL").select("cell", F.col("cell").alias("partner"), F.col("chunks").alias("partners"))
    by_pivot = {r.pivot: r for r in cells.where("pivot IS NOT NULL").collect()}
    reach, near = math.sqrt(2.0 - 2.0 * cosine) + 1e-6, []
    for ids, p in found.values():
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
        there = [k for k, i in enumerate(ids) if i in by_pivot]
        near += [(by_pivot[ids[a]].cell, by_pivot[ids[b]].cell, by_pivot[ids[b]].chunks) for a in there for b in there if d[a, b] <= by_pivot[ids[a]].radius + by_pivot[ids[b]].radius + reach]
    partners = alone.union(spark.createDataFrame(near, "cell long, partner long, partners int")) if near else alone

    chunked = placed.join(broadcast_if_small(cells.select(F.col("cell").alias("of"), "chunks")), F.col("cell") == F.col("of"))
    chunked = chunked.select(F.xxhash64("cell", part := F.pmod(F.xxhash64("uid", F.lit(7)), F.col("chunks")).cast("int")).alias("chunk"), "uid", "cell", part.alias("part"), "vector")
    planted = chunked.repartition("chunk").sortWithinPartitions("chunk", "uid").mapInArrow(_plant, "chunk long, uid long, cell long, part int, vector array<double>, local int, centres array<int>")
    planted = stored(planted.withColumn("vector", F.col("vector").cast("array<double>")))

    pairs = planted.join(broadcast_if_small(partners.withColumnRenamed("cell", "of")), F.col("cell") == F.col("of"))
    pairs = pairs.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("partners") - 1), lambda k: F.xxhash64("partner", k))))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    pairs = pairs.select(F.xxhash64(F.least("chunk", "other"), F.greatest("chunk", "other")).alias("task"), side.alias("side"), "uid", "vector", "local", "centres")
    result = stored(pairs.repartition("task").sortWithinPartitions("task", "side", "local").mapInArrow(_search, "uid long, other long, n long"))

    counts = result.where("other IS NULL").groupBy(F.col("uid").alias("of")).agg(F.sum("n").alias("n_links"))
    labels = components(result.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    joined = rows.select("uid", "vec_id").join(labels, F.col("uid") == F.col("node"), "left").select("uid", "vec_id", F.coalesce("label", "uid").alias("label"))
    joined = stored(joined.join(counts, F.col("uid") == F.col("of"), "left").select("vec_id", "label", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    smallest = stored(joined.groupBy(F.col("label").alias("of")).agg(F.min("vec_id").alias("component_id")))
    return joined.join(smallest, F.col("label") == F.col("of")).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
