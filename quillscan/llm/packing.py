"""Sequence packing by lexical retrieval.

The documents of a partition form shards of a bounded number of tokens. Each shard has a BM25 inverted index over
words; a seed document asks it for unused neighbours, which fill the window greedily. A document that doesn't fit is cut,
and its rest opens the next window, so every window but a partition's last is full; that last one is cut at powers of
two, which need no padding. Nothing is shuffled: shards follow the partitions of the input, whose size Spark bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillscan.llm import tokens
from quillscan.llm.kernels import buffers, chunks, frugal

WINDOW, END_ID = 2048, 1
#: Tokens of a shard, beyond which the next begins: the memory of a task, some 40 bytes a token.
SHARD_TOKENS = 1 << 21
#: Bytes of text that are encoded at once; temporaries are some 60 times as large.
ENCODE_BYTES = 1 << 18
#: BM25, and how many of a seed's terms (those with the highest weights) are looked up.
K1, B, QUERY_TERMS = 1.2, 0.75, 24

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """An inverted index of words over one shard: postings sorted by term, with their BM25 weights."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        h = np.concatenate(docs)
        order = np.argsort(h, kind="stable")  # by term, then by document
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        del h
        rank = np.cumsum(new, dtype=np.int32) - np.int32(1)
        term = np.empty(len(rank), np.int32)
        term[order] = rank
        self.terms_of = np.split(term, np.cumsum(lengths)[:-1])
        doc = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        new[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new)
        del order, new
        terms, self.doc, tf = rank[at], doc[at], np.diff(at, append=len(rank))
        self.begin = np.searchsorted(terms, np.arange(int(rank[-1]) + 2 if len(rank) else 1))
        del rank, doc, at
        df = np.diff(self.begin)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[self.doc] / max(1.0, lengths.mean()))
        self.weight = self.idf[terms] * tf * (K1 + 1) / (tf + norm)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first (of equals the first)."""
        terms, tf = np.unique(self.terms_of[seed], return_counts=True)
        query = terms[np.argsort(-self.idf[terms] * tf / (tf + K1), kind="stable")[:QUERY_TERMS]]
        score = np.zeros(self.n)
        for t in query:
            a, b = self.begin[t], self.begin[t + 1]
            score[self.doc[a:b]] += self.weight[a:b]
        score[~unused] = 0.0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def order_shard(terms: list[np.ndarray], lengths: list[int], window: int) -> list[int]:
    """The documents of a shard in the order in which they fill windows: a seed, its neighbours, the next seed.

    The document that is cut at a window's end is the seed of the next window.
    """
    index = Bm25(terms)
    unused = np.ones(len(terms), bool)
    out: list[int] = []
    filled = first = 0
    seed = None
    while len(out) < len(terms):
        if seed is None:
            while not unused[first]:
                first += 1
            seed = first
            unused[seed] = False
            out.append(seed)
            filled = (filled + lengths[seed]) % window
        following = None
        for k in index.neighbours(seed, unused) if filled else ():
            unused[k] = False
            out.append(int(k))
            filled += lengths[k]
            if filled >= window:
                filled %= window
                following = int(k) if filled else None
                break
        seed = following
    return out


class Packer:
    """Deals documents to sequences, one after the other, cutting where a sequence is full."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence, self.filled = window, first_sequence, 0
        self.open: list[list] = []  # pieces of the sequence that isn't full
        self.ids: list[np.ndarray] = []

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.window - self.filled, len(ids) - at)
            self.open.append([doc_id, at, take, len(ids)])
            self.ids.append(ids[at : at + take])
            self.filled += take
            at += take
            if self.filled == self.window:
                yield from self._close(self.filled)

    def _close(self, size: int) -> Iterator[tuple]:
        """Ends a sequence after ``size`` tokens; what lies beyond opens the next one."""
        offset, rest, rest_ids = 0, [], []
        for (doc_id, start, length, tokens), ids in zip(self.open, self.ids):
            take = min(length, size - offset)
            if take > 0:
                yield doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), tokens, self.sequence, offset
                offset += take
            if take < length:
                rest.append([doc_id, start + take, length - take, tokens])
                rest_ids.append(ids[take:])
        self.open, self.ids, self.filled = rest, rest_ids, self.filled - size
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        while self.filled:
            yield from self._close(1 << (self.filled.bit_length() - 1))


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: one piece, of the end id alone. Repeated rows are packed as often as they occur. An empty
    table gives no row. Sequence ids are unique; they aren't consecutive across partitions.
    ``tokenizer_path``: the vocabulary file, by default that of the installed package, found on each worker.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        coder = tokens.tokenizer(path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        kind = None
        ids_of: list[object] = []
        shard: list[np.ndarray] = []
        words: list[np.ndarray] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows = [row for k in order_shard(words, [len(x) for x in shard], window) for row in packer.add(ids_of[k], shard[k])]
            if rows:
                yield batch_of(rows)
            ids_of.clear()
            shard.clear()
            words.clear()
            size = 0

        for batch in batches:
            kind = batch.schema.field(0).type
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, ENCODE_BYTES):
                part = batch.column(0).slice(i, j - i).to_pylist()
                ids, at, terms, terms_at = coder.encode_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, doc_id in enumerate(part):
                    ids_of.append(doc_id)
                    shard.append(np.append(ids[at[k] : at[k + 1]], np.uint32(END_ID)))
                    words.append(terms[terms_at[k] : terms_at[k + 1]])
                    size += len(shard[-1])
                if size >= shard_tokens:
                    yield from flush()
        if shard:
            yield from flush()
        if rows := list(packer.finish()):
            yield batch_of(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
