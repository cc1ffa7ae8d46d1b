"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A benchmark item's windows are its runs of
8 words, or all its words if there are fewer. The frequencies of the benchmark's words are counted over all documents;
each window is then anchored at its rarest words, and only the anchors' postings (word, document, position) are stored,
those of rarest words with the words around them. A search starts from the postings of a window's rarest word, adjusts
them by its offset, intersects them with the next rarest word's, and compares the remaining offsets. No step holds more
than one document or one posting at a time. The benchmark's side of a join is broadcast only if it is measured to be small;
else the join shuffles words with their places, and no row of a word carries its document.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.session import broadcast_if_small, fresh, small_enough, stored

WINDOW = 8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null. ``lower`` is the faster way for plain ASCII, and the same there."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _SEPARATORS), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows (wid: a hash of the words, words, item: an id as text), one row for each item; items without words have none.

    An item without an id counts for hits, but not as an item.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("all"))
    runs = F.when(F.size("all") >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))), lambda i: F.slice("all", i, size))).otherwise(F.array("all"))
    rows = items.where(F.size("all") > 0).select("item", F.explode(runs).alias("words"))
    return rows.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "words", "item").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells apart texts under one id, and the words."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), words_of(F.col("text")).alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in all of ``docs``; terms that don't occur are left out."""
    tokens = _keyed(docs).select(F.explode("words").alias("term"))
    return tokens.join(broadcast_if_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``windows`` (wid, words) with their two rarest words t1, t2 and the offsets o1, o2 (null if the window is one word).

    A window with a word that occurs nowhere is dropped: it has no occurrence.
    """
    at = windows.select("wid", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    ranked = at.groupBy("wid").agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("by")).where(F.size("by") == F.size("words"))
    get = lambda k, f: F.get("by", F.lit(k))[f]
    return ranked.select("wid", "words", get(0, "term").alias("t1"), get(0, "offset").alias("o1"), get(1, "term").alias("t2"), get(1, "offset").alias("o2"))


def build_index(docs: DataFrame, anchors: DataFrame, size: int = WINDOW) -> DataFrame:
    """Postings (term, doc_id, h, pos, around, before) of ``anchors`` (term, rarest), written to the shared folder.

    ``around`` is set for rarest words only: up to ``size - 1`` words on either side, ``before`` of them before the word.
    """
    before = F.least(F.col("pos"), F.lit(size - 1))
    around = F.when(F.col("rarest"), F.slice("words", F.col("pos") - before + 1, before + size))
    if small_enough(anchors):  # the join streams: a document's words are there once, whatever their number
        at = _keyed(docs).select("doc_id", "h", "words", F.posexplode("words").alias("pos", "term"))
        hits = at.join(F.broadcast(anchors), "term")
        return stored(hits.select("term", "doc_id", "h", "pos", around.alias("around"), before.alias("before")))
    # words with their places are shuffled; what stands around the rarest is then cut from each document at once
    at = _keyed(docs).distinct().select("doc_id", "h", F.posexplode("words").alias("pos", "term"))
    hits = stored(at.join(anchors, "term").select("term", "doc_id", "h", "pos", "rarest"))
    wanted = hits.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("term", "pos", "rarest")).alias("hits"))
    texts = _keyed(docs).join(wanted, F.expr("doc_id <=> of AND h = of_h"))

    def posting(x: Column) -> Column:
        lead = F.least(x["pos"], F.lit(size - 1))
        return F.struct(x["term"].alias("term"), x["pos"].alias("pos"), F.when(x["rarest"], F.slice("words", x["pos"] - lead + 1, lead + size)).alias("around"), lead.alias("before"))

    postings = texts.select("doc_id", "h", F.explode(F.transform("hits", posting)).alias("p"))
    return stored(postings.select("p.term", "doc_id", "h", "p.pos", "p.around", "p.before"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences (doc_id, h, start, n, wid) of anchored ``windows`` in ``index``."""
    rarest = index.where(F.col("around").isNotNull()).join(broadcast_if_small(windows), F.col("term") == F.col("t1"))
    aligned = rarest.select("doc_id", "h", (F.col("pos") - F.col("o1")).alias("start"), "words", "wid", "t2", "o2", F.slice("around", F.greatest(F.col("before") - F.col("o1"), F.lit(0)) + 1, F.size("words")).alias("there")).where("start >= 0")
    second = index.select(F.col("term").alias("term2"), F.col("doc_id").alias("doc2"), F.col("h").alias("h2"), F.col("pos").alias("pos2"))
    both = aligned.where("t2 IS NOT NULL").join(second, F.expr("doc_id <=> doc2 AND h = h2 AND start + o2 = pos2 AND t2 = term2"), "left_semi")
    found = both.unionByName(aligned.where("t2 IS NULL"))
    return found.where("there = words").select("doc_id", "h", "start", F.size("words").alias("n"), "wid")


def proximity_matches(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """Postings (doc_id, h, pos) of the rarest of ``terms`` with every other term at most ``distance`` words away.

    Lists are intersected from the rarest on, by blocks of ``distance`` positions, so a hot document is spread.
    """
    counts = {r.term: r["count"] for r in index.where(F.col("term").isin(terms)).groupBy("term").count().collect()}
    terms = sorted(dict.fromkeys(terms), key=lambda t: (counts.get(t, 0), t))
    step = max(1, distance)
    left = index.where(F.col("term") == terms[0]).select("doc_id", "h", "pos")
    for t in terms[1:]:
        right = index.where(F.col("term") == t).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p2"), F.floor(F.col("pos") / step).alias("b2"))
        blocks = left.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("pos") / step) + k)))
        left = blocks.join(right, F.expr(f"doc_id <=> d2 AND h = h2 AND b = b2 AND abs(pos - p2) <= {distance}"), "left_semi").select("doc_id", "h", "pos").distinct()
    return left


def hits_by_document(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Of documents with an occurrence: doc2, h2 (their id and the hash of their text), n_hit, n_items, items_sha256, longest
    (words of the longest window)."""
    items = stored(windows_of(benchmark, size))
    windows = items.select("wid", "words").dropDuplicates(["wid"])
    counts = stored(term_counts(docs, windows.select(F.explode("words").alias("term")).distinct()))
    windows = stored(anchored(windows, counts))
    anchors = windows.select(F.col("t1").alias("term"), F.lit(True).alias("rarest")).union(windows.select("t2", F.lit(False)))
    anchors = anchors.where(F.col("term").isNotNull()).groupBy("term").agg(F.max("rarest").alias("rarest"))
    matches = stored(phrase_matches(build_index(docs, anchors, size), windows))
    spans = F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))
    per_doc = matches.groupBy(F.col("doc_id").alias("doc2"), F.col("h").alias("h2")).agg(spans.alias("spans"), F.max("n").alias("longest"))
    # documents and windows first: an item's ids meet a document once for each window, not for each occurrence
    by_window = matches.groupBy(F.col("doc_id").alias("doc3"), F.col("h").alias("h3"), "wid").agg(F.lit(1).alias("one"))
    named = items.where(F.col("item").isNotNull()).select(F.col("wid").alias("of"), "item")
    found = by_window.join(broadcast_if_small(named), F.col("wid") == F.col("of")).groupBy("doc3", "h3").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = per_doc.join(found, F.expr("doc2 <=> doc3 AND h2 = h3"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return both.select("doc2", "h2", F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "longest")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated.

    Null has no words. Repeated rows are counted as often as they occur and returned as often. An empty benchmark hits
    nothing.
    """
    per_doc = hits_by_document(docs, benchmark, size)
    rows = _keyed(docs).select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return rows.join(per_doc, F.expr("doc_id <=> doc2 AND h = h2"), "left").select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_items", zero) >= 2).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold ``size`` consecutive words of a benchmark item, or are contaminated: with windows of
    two items or more, where an item of fewer words is one window."""
    leaks = stored(hits_by_document(docs, benchmark, size).where((F.col("longest") >= size) | (F.col("n_items") >= 2)).select("doc2", "h2"))
    of, h = (fresh(x, docs.columns) for x in ("leak_id", "leak_hash"))
    leaks = leaks.toDF(of, h)
    same = docs["doc_id"].eqNullSafe(leaks[of]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaks[h])
    return docs.join(leaks, same, "left_anti")


def oracle_sql(size: int = WINDOW) -> str:
    """DuckDB SQL for the rows of ``contamination`` without h."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark),
starts AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, ws[i : i + {size - 1}] AS g FROM starts),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
ns AS (SELECT DISTINCT len(g) AS n FROM w),
dw AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n),
m AS MATERIALIZED (SELECT rid, i, n, item FROM (SELECT rid, n, i, ws[i : i + n - 1] AS g FROM dw) x JOIN w USING (g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""
