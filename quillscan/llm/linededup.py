"""Line dedup by a log-template tree, in DataFrame operations.

A line's tokens are what white space separates; a token with a digit is a variable field. Lines are parsed by a tree of
fixed depth: the number of tokens, then the leading tokens (fields count alike). In a leaf, two lines are of one template
if at least ``SAME`` of their tokens agree place by place; the places that differ are fields of the template too. Two lines
that agree so far share one of the blocks into which the places behind the leading tokens are cut, so lines are compared
only within blocks: each with the smallest one (by hash), and where that leaves a block in several components, all with
each other, inside one task if they are few. A block of more lines is cut again at its other places, by the same argument
without losing a pair, until its parts are few lines, or agree in so many places that all of them are of one template.
Templates are chains of lines that agree: the outcome doesn't depend on the order of lines, and no leaf, however many lines
it has, is gathered in one task.

A template of ``MIN_TOKENS`` tokens or more that occurs in several documents recurs: its first line (by doc_id, then place)
stays, the others are dropped. Fewer tokens ("Of course.") say nothing of where a line comes from, whatever the corpus'
size: such lines have no template. Lines are pre-aggregated by hash; only leaves with several distinct lines carry tokens
any further, as hashes of 16 bits that find the blocks. Whether two lines agree is decided on 64-bit hashes of the tokens,
read again from the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.components import components
from quillscan.llm.kernels import U, buffers, chunks, frugal, list_array, mix, powers, sorted_groups
from quillscan.session import fresh, stored

#: Leading tokens of the tree's path; the share of equal tokens of a template's lines; documents from which it recurs.
DEPTH, SAME, MIN_DOCS = 3, 0.8, 2
#: Tokens of a template, at least: the path's and two behind it.
MIN_TOKENS = DEPTH + 2
#: Lines that are compared inside one task, all with each other.
BLOCK = 1024
#: Words of 64 bits, as a power of two, of the filter for texts to be read again: rows of a broadcast, at most.
FILTER_WORDS = 18
_FIELD = U(0xA0761D6478BD642F)
#: White space, but for U+0085 and U+00A0, which are two bytes.
_BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _of_lines(text: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of the text's lines, which are cut once a row, however often a lambda in ``make`` takes one."""
    return F.get(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n", -1)), make), F.lit(0))


def line_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with tokens of UTF-8 rows (see ``kernels.buffers``): row, place in the row, and first token (with the
    end as last); and a 64-bit hash of each token, the same for all tokens with a digit."""
    blank = _BLANKS[data]
    wide = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
    blank[wide] = blank[wide + 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~blank
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    start = np.flatnonzero(inside & ~(before & ~edge)[:-1])
    end = np.flatnonzero(inside & ~(after & ~edge)[1:]) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(1, np.int64), np.zeros(0, U)
    lengths = end - start
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    h = np.add.reduceat((data[inside].astype(U) + U(1)) * powers(int(lengths.max()))[place], at)
    h = mix(h + lengths.astype(U) * U(0xD6E8FEB86659FD93))
    digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    h[digits[end] > digits[start]] = _FIELD
    row = np.searchsorted(offsets, start, "right") - 1
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    line = feeds[start] - feeds[offsets[row]]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (line[1:] != line[:-1]))))
    return row[first], line[first], np.append(first, len(start)), h


def line_keys(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lines and of their leaves, from their tokens; lines of fewer tokens than ``DEPTH`` have no leaf (0)."""
    n = np.diff(first)
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    line = mix(np.add.reduceat(mix(h + U(1)) * powers(int(n.max()))[place], first[:-1]) + n.astype(U))
    leaf = np.zeros(len(n), U)
    deep = np.flatnonzero(n >= DEPTH)
    for k in range(DEPTH):
        leaf[deep] = mix(leaf[deep] * U(0x9E3779B97F4A7C15) + h[first[deep] + k])
    leaf[deep] = mix(leaf[deep] + n[deep].astype(U))
    return line.view(np.int64), leaf.view(np.int64)


@frugal
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, at, line, leaf and words (16 bits of each token's hash) of the lines of at least
    ``MIN_TOKENS`` tokens."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j in chunks(offsets):
            row, at, first, h = line_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            line, leaf = line_keys(first, h)
            n = np.diff(first)
            good = n >= MIN_TOKENS
            words = list_array((h >> U(48)).astype(np.uint16).view(np.int16)[np.repeat(good, n)], n[good], pa.int16())
            which = pa.array(row[good] + i)
            columns = [batch.column(0).take(which), batch.column(1).take(which), pa.array(at[good].astype(np.int32)), pa.array(line[good]), pa.array(leaf[good]), words]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "at", "line", "leaf", "words"])


@frugal
def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line, text (of the line alone) -> line, words (64 bits of each token's hash)."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            row, _, first, h = line_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), list_array(h.view(np.int64), np.diff(first), pa.int64())], ["line", "words"])


def _block_keys() -> Column:
    """Hashes of the blocks behind the leading tokens of ``words``, one more than places that may differ, with their numbers."""
    blocks = f"(int(floor(size(words) * {1 - SAME:.6f} + 1e-9)) + 1)"
    cut = lambda b: f"({b} * (size(words) - {DEPTH}) div {blocks})"
    return F.expr(f"transform(sequence(0, {blocks} - 1), b -> xxhash64(leaf, b, slice(words, {DEPTH} + 1 + int({cut('b')}), int({cut('(b + 1)')} - {cut('b')}))))")


def shared_blocks(crowd: DataFrame) -> DataFrame:
    """Blocks of several lines (key, number: of the block in its lines, line, leader: the smallest), from distinct ``crowd``
    (leaf, line: hash, words: 16-bit hashes of its tokens). Equal tokens have equal hashes, so no block is missed; what it
    holds need not agree."""
    keys = stored(crowd.select("line", F.posexplode(_block_keys()).alias("number", "key")))
    leaders = keys.groupBy(F.col("key").alias("of")).agg(F.min("line").alias("leader"), F.max("line").alias("last")).where("leader < last")
    return stored(keys.join(leaders, F.col("key") == F.col("of")).select("key", "number", "line", "leader"))


def perhaps_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``texts`` (h: a hash) whose h is perhaps among those of ``wanted`` (of_h): all that are, and of the others one in
    as many as ``wanted`` has hashes to the filter's bits. No text is shuffled."""
    word = lambda h: F.shiftrightunsigned(h, 64 - FILTER_WORDS)
    bit = lambda h: f"int(shiftrightunsigned({h}, {58 - FILTER_WORDS}) & 63)"
    bits = wanted.groupBy(word("of_h").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit('of_h')})")).alias("bits"))
    return texts.join(F.broadcast(bits), (word("h") == F.col("word")) & F.expr(f"getbit(bits, {bit('h')}) = 1"), "left_semi")


def exact_words(docs: DataFrame, places: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, words: 64-bit hashes of its tokens) of the distinct ``lines`` (line), each read again from one of its places."""
    places = places.join(lines.withColumnRenamed("line", "want"), F.col("line") == F.col("want"), "left_semi")
    one = places.groupBy("line").agg(F.min(F.struct("doc_id", "h", "at")).alias("p"))
    one = stored(one.groupBy(F.col("p.doc_id").alias("of"), F.col("p.h").alias("of_h")).agg(F.collect_list(F.struct("line", "p.at")).alias("wanted")))
    texts = perhaps_wanted(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text"), one)
    texts = texts.join(one, F.expr("doc_id <=> of AND h = of_h"))
    found = _of_lines(F.col("text"), lambda lines: F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), F.get(lines, w["at"]).alias("text"))))
    found = texts.select(F.explode(found).alias("w"))
    return stored(found.select("w.line", "w.text").mapInArrow(_exact, "line long, words array<long>").dropDuplicates(["line"]))


def template_links(shared: DataFrame, exact: DataFrame) -> DataFrame:
    """Pairs (a, b) of a block's leader and its other lines that are of one template, by their ``exact`` words."""
    pairs = shared.where("line <> leader").select(F.col("leader").alias("a"), F.col("line").alias("b")).distinct()
    a, b = (exact.select(F.col("line").alias(f"line_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("line_a")).join(b, F.col("b") == F.col("line_b"))
    agree = F.size(F.filter(F.zip_with("words_a", "words_b", lambda x, y: x == y), lambda e: e))
    return both.where((F.size("words_a") == F.size("words_b")) & (agree >= SAME * F.size("words_a") - 1e-9)).select("a", "b")


@frugal
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (block, line, label, words), sorted by block, some ``BLOCK`` of one label and as many others at most -> links
    (a, b) across labels, as a forest."""
    for t in sorted_groups(batches):
        line, label = (t.column(c).to_numpy() for c in ("line", "label"))
        words = [np.frombuffer(x, "<i8") for x in t.column("words").to_pylist()]
        size = np.array([len(x) for x in words])
        _, root = np.unique(label, return_inverse=True)
        pairs = []
        for n in np.unique(size):  # but for a collision of keys there is one
            part = np.flatnonzero(size == n)
            there = np.stack([words[x] for x in part])
            for k, i in enumerate(part[:-1]):
                rest = part[k + 1 :]
                near = np.flatnonzero(root[rest] != root[i])
                if not len(near):
                    continue
                for x in rest[near[(there[k + 1 + near] == there[k]).sum(axis=1) >= SAME * n - 1e-9]]:
                    if root[x] != root[i]:
                        pairs.append((min(line[i], line[x]), max(line[i], line[x])))
                        root[root == root[x]] = root[i]
        if pairs:
            x, y = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


@frugal
def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, line, label, path, words -> key, line, label, path of the blocks into which the key's other places are cut.

    ``path``: the blocks taken so far. ``done``: the lines of the new key agree in all but the places that may differ.
    """
    for batch in batches:
        keys, lines, labels = (batch.column(c).to_numpy() for c in ("key", "line", "label"))
        paths, words = batch.column("path").to_pylist(), batch.column("words").to_pylist()
        out: list[tuple] = []
        for key, line, label, path, packed in zip(keys, lines, labels, paths, words):
            w = np.frombuffer(packed, "<i8").view(U)
            free, differ = open_places(len(w), path)
            for b, part in enumerate(np.array_split(free, differ + 1)):
                h = mix(np.append(w[part], np.array([key, b], np.int64).view(U)) + np.arange(len(part) + 2, dtype=U) * U(0x9E3779B97F4A7C15))
                new = int(mix(np.bitwise_xor.reduce(h, keepdims=True)).view(np.int64)[0])
                out.append((new, line, label, [*path, b], len(free) - len(part) <= differ))
        if out:
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "line", "label", "path", "done"])


def open_places(n: int, path: list[int]) -> tuple[np.ndarray, int]:
    """Of lines of ``n`` tokens the places that the blocks of ``path`` leave open, and how many may differ."""
    differ = int(np.floor(n * (1 - SAME) + 1e-9))
    free = np.arange(DEPTH, n)
    for k, b in enumerate(path):
        if k:
            cut = np.array_split(free, differ + 1)
        else:  # as ``_block_keys`` cuts
            ends = [DEPTH + x * (n - DEPTH) // (differ + 1) for x in range(differ + 2)]
            cut = [np.arange(i, j) for i, j in zip(ends, ends[1:])]
        free = np.concatenate([part for x, part in enumerate(cut) if x != b])
    return free, differ


@frugal
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line, words (array<long>) -> of, words (eight bytes each)."""
    for batch in batches:
        words = [x.values.to_numpy().astype("<i8").tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["of", "words"])


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (key, line, label, path) of the keys with several labels: also n (lines of the key), main (the label of most
    of them), others (lines of other labels) and first (the smallest line)."""
    by_label = rows.groupBy(F.col("key").alias("of"), "label").agg(F.count("*").alias("mine"), F.min("line").alias("first"))
    keys = by_label.groupBy("of").agg(F.sum("mine").alias("n"), F.max(F.struct("mine", "label")).alias("most"), F.min("first").alias("first"), F.count("*").alias("labels")).where("labels > 1")
    return rows.join(keys, F.col("key") == F.col("of")).withColumn("main", F.col("most.label")).withColumn("others", F.col("n") - F.col("most.mine")).drop("of", "most", "labels")


def open_links(shared: DataFrame, labels: DataFrame, exact: DataFrame) -> DataFrame:
    """Pairs (a, b) of one template in those blocks of ``shared`` that still hold several of the components ``labels``.

    A block of at most ``BLOCK`` lines is compared inside a task. If a larger one has one main component and at most
    ``BLOCK`` other lines, these are compared with each part of it. The lines of any other block go to finer blocks (one
    more than places that may differ, so that lines that agree share one), and again while these are large and hold
    several components; where all places but those that may differ are equal, each line is linked with the smallest.
    """
    placed = shared.join(labels.withColumnRenamed("node", "of"), F.col("line") == F.col("of"), "left").select("key", F.array("number").alias("path"), "line", F.coalesce("label", "line").alias("label"))
    rows = stored(_sized(stored(placed)).where("n > 2"))  # two lines are a leader and the other
    wanted = rows.select(F.col("line").alias("want")).distinct()
    packed = stored(exact.join(wanted, F.col("line") == F.col("want"), "left_semi").select("line", "words").mapInArrow(_packed, "of long, words binary"))
    with_words = lambda df: df.join(packed, F.col("line") == F.col("of")).drop("of")
    few, split = F.col("n") <= BLOCK, F.col("others") <= BLOCK
    parts = F.when(few, 1).otherwise(F.ceil((F.col("n") - F.col("others")) / BLOCK)).cast("int")
    mine = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("line", F.lit(1)), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    found = []
    while True:
        dealt = rows.where(few | split).withColumn("parts", parts).select(F.col("key"), F.explode(mine).alias("part"), "line", "label")
        dealt = with_words(dealt.select(F.xxhash64("key", "part").alias("block"), "line", "label"))
        found.append(stored(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_compare, "a long, b long").distinct()))
        large = rows.where(~few & ~split)
        if not large.limit(1).count():
            return reduce(DataFrame.union, found)
        finer = with_words(large.select("key", "line", "label", "path")).select("key", "line", "label", "path", "words").mapInArrow(_finer, "key long, line long, label long, path array<int>, done boolean")
        rows = stored(_sized(stored(finer)))
        found.append(stored(rows.where("done AND line <> first").select(F.col("first").alias("a"), F.col("line").alias("b")).distinct()))
        rows = rows.where("NOT done")


def recurring(docs: DataFrame) -> DataFrame:
    """Lines to drop of the rows of ``docs`` (doc_id, text): doc_id, h (of the text), drop: their places, from 0."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # lines are parsed once; the tokens' hashes lie in a column of their own, which only the comparison below reads
    places = stored(keyed.mapInArrow(_parse, f"doc_id {kind}, h long, at int, line long, leaf long, words array<short>"))

    crowded = places.groupBy(F.col("leaf").alias("of")).agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("of")
    once = places.select("leaf", "line", "words")
    # a table: then both sides of the join are plain exchanges, and a hot leaf's rows can be split among tasks
    crowded = stored(crowded)
    crowd = stored(once.join(crowded.hint("merge"), F.col("leaf") == F.col("of"), "left_semi").dropDuplicates(["line"]))
    shared = shared_blocks(crowd)
    exact = exact_words(docs, places, shared.select("line").distinct())
    edges = stored(template_links(shared, exact))
    labels = components(edges)
    more = stored(open_links(shared, labels, exact))
    if more.limit(1).count():
        labels = components(edges.union(more))
    labels = labels.withColumnRenamed("node", "of")

    templated = places.join(labels, F.col("line") == F.col("of"), "left").select("doc_id", "h", "at", F.coalesce("label", "line").alias("template"))
    by_doc = stored(templated.groupBy("template", "doc_id", "h").agg(F.collect_set("at").alias("places")))
    seen = by_doc.groupBy(F.col("template").alias("of")).agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "h")).alias("keeper"))
    seen = stored(seen.where(F.col("docs") >= MIN_DOCS))
    hit = by_doc.join(seen, F.col("template") == F.col("of"))
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("h") == F.col("keeper.h"))
    drop = F.when(keeps, F.array_remove("places", F.array_min("places"))).otherwise(F.col("places"))
    return hit.select("doc_id", "h", F.explode(drop).alias("place")).groupBy("doc_id", "h").agg(F.collect_list("place").alias("drop"))


def dedup_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` (doc_id, text and any others) with recurring lines dropped from text, and two counts after its columns.

    Null texts and rows without recurring lines stay as they are; lines of fewer than ``MIN_TOKENS`` tokens are never dropped. Rows that repeat
    each other (id and text) count as one document and lose the same lines. A doc_id of null comes before all others.
    """
    if clash := {c.lower() for c in docs.columns} & {n_lines.lower(), n_dropped.lower()}:
        raise ValueError(f"columns of this name are there already: {sorted(clash)}")
    names = [*docs.columns, n_lines, n_dropped]
    of, h, drop = (fresh(x, names) for x in ("of", "hash", "drop"))
    dropped = recurring(docs).toDF(of, h, drop)
    match = docs["doc_id"].eqNullSafe(dropped[of]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dropped[h])
    joined = docs.join(dropped, match, "left")
    text = docs["text"]
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    left = F.array_except(F.sequence(F.lit(0), n - 1), dropped[drop])
    kept = _of_lines(text, lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *(F.when(dropped[drop].isNull(), text).otherwise(kept).alias(c) if c == "text" else docs[c] for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(n).cast("long").alias(n_lines),
        F.coalesce(F.size(dropped[drop]), F.lit(0)).cast("long").alias(n_dropped),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per row doc_id, text without its recurring lines, n_lines (before) and n_dropped."""
    return dedup_lines(docs.select("doc_id", "text"))
