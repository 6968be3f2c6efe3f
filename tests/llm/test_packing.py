"""Packing: token ids against the tokenizer, the plan against every packing of small instances, whole results."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(texts):
    full = Tokenizer.from_file(PATH)
    return [full.encode(t or "", add_special_tokens=False).ids for t in texts]


TEXTS = [
    "", " \n\t ", "Hello, world! It's 2024 don't", "É́cole ÀB̀ ŠİĳŉǅΣΑΣ Σ", "a\x1cb\x85c d e\tf", "日本語のテキスト。次の文", "x<|endoftext|>y <|startoftext|> z",
    "'s'T 'LL n't", "### *** $$$%%", "a" * 500, "k K ſ ﬁ", "👩‍👩‍👧 é é", "퟿﻿ zero​width", "tab\tstop\r\nline", "word," * 300, "\x00 \x7f",
]


@pytest.mark.parametrize("direct", [True, False])
def test_ids_are_the_tokenizers(spark, sf, direct):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    w = K.WordTokenizer(PATH)
    assert w.merges
    if not direct:
        w.merges, texts = None, texts[:60]
    for _ in range(2):  # from memory, too
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == reference_ids(texts)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 20)
    w, texts = K.WordTokenizer(PATH), [" ".join(f"w{i * k % 97}x, Y{i}." for i in range(60)) for k in range(1, 6)]
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == reference_ids(texts)
    assert len(w) + len(w.old) < 300


def test_long_stretch_is_cut_where_the_tokenizer_cuts(monkeypatch):
    monkeypatch.setattr(K, "LONG_CHUNK", 40)
    text = "日本語のテキスト。次の文、é!" * 30
    assert len(list(K._parts(text))) > 3
    assert [np.frombuffer(x, "<u4").tolist() for x in K.WordTokenizer(PATH).encode([text])] == reference_ids([text])


def fewest(lengths, capacity):
    """The least number of sequences, by trying every set that holds the first piece."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for n in range(len(rest) + 1):
        for others in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in others) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in others], capacity))
    return best


def test_dominance_loses_nothing():
    rng = random.Random(5)
    fixed_some = 0
    for _ in range(250):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        fixed, left = K.reduce_by_dominance(dict(Counter(lengths)), capacity)
        used = Counter()
        for one, times in fixed:
            assert sum(x * n for x, n in one.items()) <= capacity
            for x, n in one.items():
                used[x] += n * times
        assert used + Counter(left) == Counter(lengths)
        fixed_some += bool(fixed)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(lengths, capacity), (lengths, capacity)
    assert fixed_some > 150


def one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([12, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        groups = K.best_fit(dict(Counter(lengths)), capacity)
        assert sorted(capacity - sum(x * n for x, n in one.items()) for one, times in groups for _ in range(times)) == one_by_one(lengths, capacity)


def packed(df, capacity):
    rows = df.collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, len(sequences)


def test_pack(spark):
    texts = [*TEXTS, None, "one two three " * 200, "same text"] + ["same text"] * 40
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("offset", F.lit("clash"))
    first = df.limit(5).collect()
    df = df.unionByName(df.limit(5))
    out = K.pack(df, PATH, capacity=64, shard_rows=7)
    rows, used = packed(out, 64)
    docs = Counter((i if i else None, tuple(ids) + (1,)) for i, ids in enumerate(reference_ids(texts)))
    docs.update((r.doc_id, tuple(ids) + (1,)) for r, ids in zip(first, reference_ids([r.text for r in first])))
    wanted = Counter((d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()), ids[k : k + 64]) for (d, ids), n in docs.items() for _ in range(n) for k in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == wanted
    assert used <= len(one_by_one([r.length for r in rows], 64))
    assert K.pack(df.limit(0), PATH).count() == 0
    assert "ids" not in K.pack(df.limit(1), PATH, ids=False).columns


def test_query_fills_sequences(spark, sf):
    from eventide.llm.queries import op13_best_fit_packing

    rows, used = packed(op13_best_fit_packing(spark, sf), 4096)
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: len(x) + 1 for r, x in zip(documents, reference_ids([r.text for r in documents]))}
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == Counter(ids)
    assert used <= len(one_by_one([r.length for r in rows], 4096))
    assert used <= 1.02 * sum(ids.values()) / 4096 + 1
