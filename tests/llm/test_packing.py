"""Packing against a round trip through the tokenizer itself."""

import os
import pathlib
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillscan.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's Ünïted: they'll pay 12 %, won't they? ''s 'sabc x's",
    None,
    "",
    "   \n\t ",
    "五 六 and İx \x1c ẞ <|endoftext|> tail",
    "a" * 5000,
    "word " * 9000,
    "It's Ünïted: they'll pay 12 %, won't they? ''s 'sabc x's",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers_own(text):
    want = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    assert tokens.tokenizer(PATH).encode(text).tolist() == want


def check(rows, texts, window=2048):
    tok = Tokenizer.from_file(PATH)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, whole in ids.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == len(whole)
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(sequences)


def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    padding, _ = check(packing.pack(df, shard_tokens=4096).collect(), TEXTS)
    assert padding == 0


def test_an_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).collect() == []
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    rows = packing.pack(twice).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in rows) and sum(r.length for r in rows) == 3 + 3 + 1


def test_neighbours_share_words():
    docs = [np.array(x) for x in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 7, 9], [4, 5, 8, 9], [10, 11], [1, 3, 12])]
    index = packing.Bm25(docs)
    unused = np.array([False, True, True, True, True, True])
    assert set(index.neighbours(0, unused)[:2].tolist()) == {2, 5}  # 1 and 2, 1 and 3; the others share 9 at most
    assert sorted(packing.order_shard(docs, [600] * 6, 2048)) == list(range(6))


def test_every_document_has_terms_whatever_its_letters():
    texts = ["She said “hello” to the baker", "the baker — said hello", "Привет большой мир", "мир большой", "五六七", "六", "<|endoftext|> baker", "a" * 2000, "🙂"]
    raw = [t.encode() for t in texts]
    _, _, terms, at = tokens.tokenizer(PATH).encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    of = [set(terms[a:b].tolist()) for a, b in zip(at, at[1:])]
    assert all(of) and len(at) == len(texts) + 1
    assert len(of[0] & of[1]) == 4 and len(of[2] & of[3]) == 2 and len(of[4] & of[5]) == 1 and len(of[0] & of[6]) == 1
    index = packing.Bm25([terms[a:b] for a, b in zip(at, at[1:])])
    unused = np.arange(len(texts)) != 2
    assert index.neighbours(2, unused).tolist() == [3]


MEMORY = """
import re, sys, threading, time
import numpy as np, pyarrow as pa
from pyspark import TaskContext
from quillscan.llm import packing

TaskContext.get = staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))
column = type("C", (), {"dataType": type("K", (), {"simpleString": staticmethod(lambda: "bigint")})})
docs = type("D", (), {"schema": {"doc_id": column}, "select": lambda s, *a: s, "mapInArrow": lambda s, run, kind: run})()
run = packing.pack(docs)
rng = np.random.default_rng(3)
words = np.array(["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(60000)])
batch = pa.record_batch([pa.array(range(5000)), pa.array([" ".join(rng.choice(words, 400)) for _ in range(5000)])], ["doc_id", "text"])
held = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
most, ended = [0], []


def watch():
    while not ended:
        most[0] = max(most[0], held())
        time.sleep(0.005)


before = held()
threading.Thread(target=watch, daemon=True).start()
tokens = sum(sum(x.column(2).to_pylist()) for x in run(iter([batch])))
ended.append(1)
print(tokens, most[0] - before, held() - before)
"""


def test_a_task_takes_and_keeps_little_memory():
    root = pathlib.Path(packing.__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)}).stdout
    n, most, kept = map(float, out.split())
    assert n > packing.SHARD_TOKENS
    assert most < 95 and kept < 15  # MB; it was 112 and 31 or more


def test_long_pieces_do_not_grow_the_table_without_bound(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_IDS", 1000)
    coder = tokens.WordTokenizer(PATH)
    texts = ["".join(chr(97 + (i * k * k + k) % 26) for k in range(900)) for i in range(20)]
    want = Tokenizer.from_file(PATH)
    assert all(coder.encode(t).tolist() == want.encode(t, add_special_tokens=False).ids for t in texts)
    assert coder.used < 1000 + 900
