"""Alignment against a plain version that walks both tokenizers' tokens, on edge cases and on the given texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventide.llm import align as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text):
    """(id, bytes) lists by the libraries themselves."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer, decoders

    if not plain_tokens.__dict__:
        plain_tokens.a = Tokenizer.from_file(PATHS[0])
        plain_tokens.a.encode_special_tokens = True
        plain_tokens.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in chars]
        plain_tokens.of = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(rest)}
    if not text:
        return [], []
    e = plain_tokens.a.encode(" " + text, add_special_tokens=False)
    xs = [(i, bytes(plain_tokens.of[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    ys = []
    for i in plain_tokens.b.encode(text):
        p = plain_tokens.b.id_to_piece(i)
        ys.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (xs, ys) if b"".join(x for _, x in xs) == raw == b"".join(y for _, y in ys) else ([], [])


def plain_align(texts):
    rows, counts, linked = [], Counter(), []
    for t in texts:
        xs, ys = plain_tokens(t)
        ends = []
        for tokens in (xs, ys):
            at, e = 0, {}
            for k, (_, raw) in enumerate(tokens):
                at += len(raw)
                e[at] = k
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        said, p, q, mine = [], 0, 0, []
        for c in cuts:
            i, j = ends[0][c] + 1, ends[1][c] + 1
            said.append(",".join(str(x) for x, _ in xs[p:i]) + "|" + ",".join(str(y) for y, _ in ys[q:j]))
            mine.append((xs[i - 1][0], ys[j - 1][0]))
            p, q = i, j
        counts.update(mine)
        linked.append(mine)
        text = ";".join(said)
        rows.append([len(xs), len(ys), len(cuts), len(mine), hashlib.sha256(text.encode()).hexdigest() if xs else "", text])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [tuple([*r[:4], sum(counts[m] == best[m[1]] for m in ms), sum(counts[m] for m in ms), *r[4:]]) for r, ms in zip(rows, linked)]


TEXTS = [
    None, "", " ", "  two  spaces ", "Hello, world!", "x<|endoftext|>y </s> <s> <unk> <0x41>", "日本語 テキスト 😀 é", "a▁b", "tab\tline\n\n\r\n end ", "aaaa" * 300, "\x00\x01 nul",
    "é é ﬁ Ⅷ Ａ", "word " * 2000, "don't won't I'll", "12345 67890 3.14", "ﬀ x y", "same", "same", "tie tie", "﻿bom",
]

COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("part", [200_000, 40])
def test_align(spark, monkeypatch, part):
    monkeypatch.setattr(A, "PART_CHARS", part)
    a, b = A._both(*PATHS)
    assert a.direct and b.cuts
    for t in TEXTS:
        assert tuple(map(list, A.encode_both(t or "", a, b))) == tuple([i for i, _ in x] for x in plain_tokens(t))
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    out = A.align(df, *PATHS)
    wanted = plain_align([*TEXTS, TEXTS[4]])
    assert Counter(tuple(r[c] for c in ["doc_id", *COLS]) for r in out.collect()) == Counter((d, *w) for (d, _), w in zip([*rows, rows[4]], wanted))
    assert A.align(df.limit(0), *PATHS).count() == 0
    assert A.align(df.where("text IS NULL"), *PATHS, groups=False).columns == ["doc_id", *COLS[:-1]]


def test_query_over_given_texts(spark, sf):
    from eventide.llm.queries import op12_token_alignment

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    wanted = {r.doc_id: w[:-1] for r, w in zip(docs, plain_align([r.text for r in docs]))}
    assert {r.doc_id: tuple(r[c] for c in COLS[:-1]) for r in op12_token_alignment(spark, sf).collect()} == wanted


def test_gallop():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (5, 100_000), (300, 300), (70_000, 200_000), (100_000, 1)):
        long = np.sort(rng.choice(10**7, m, replace=False))
        short = np.minimum(np.sort(rng.choice(10**7, n, replace=False)), long[-1])
        assert (A.gallop(short, long) == np.searchsorted(long, short)).all()


def test_pairs_end_with_each_other(spark, sf):
    """What bounds the counts: of two tokens that end together one ends with the other."""
    a, b = A._both(*PATHS)
    pairs = A.pair_counts(A.links(spark.read.parquet(f"{sf}/documents.parquet"), *PATHS, groups=False), len(b.tokens)).collect()
    assert pairs
    for r in pairs:
        x, y = a.tokens[r.pair // len(b.tokens)], b.tokens[r.pair % len(b.tokens)]
        assert x.endswith(y) or y.endswith(x)
