"""Operators against brute force, on edge cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import glob
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import bpe as B
from eventide.llm import common as C
from eventide.llm import line_dedup as LD
from eventide.llm import main_text as MT
from eventide.llm import minhash as MH
from eventide.llm import substrings as SS
from eventide.llm import warc as W
from eventide.llm.decontaminate import decontaminate
from eventide.llm.licenses import license_scan
from eventide.llm.quality_rules import log_ratios, quality_rules, trusted_ids


def docs(spark, texts, **columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_words_keep_other_cases(spark):
    df = docs(spark, ["ÉCOLE StraßeK x", None, "  ", "a\x0bB\tc"])
    out = df.select("doc_id", C.alnum_words(C.ascii_lower(C.whole("text"))).alias("w"), C.space_words(C.whole("text")).alias("s")).orderBy("doc_id").collect()
    assert out[0].w == ["École", "straße\u212a", "x"]  # the Kelvin sign is not a K
    assert out[1].w == [] and out[2].s == [] and out[3].s == ["a", "B", "c"]


# ---- line dedup


def test_line_dedup(spark):
    texts = [f" Same Line\t\nown {i}\n" for i in range(12)] + ["same line", None, "", "x\n\nx", "\n".join(f"l{k}" for k in range(5000))] + ["nine"] * 9 + ["É"] * 10 + ["é"] * 9
    out = by_id(LD.line_dedup(docs(spark, texts, n_lines=F.lit("clash"))), "n_lines", "n_dropped", "kept_text")
    keys = Counter()
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(C.UPPER, C.UPPER.lower()))
    for t in texts:
        keys.update({norm(x) for x in (t or "").split("\n")})
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (norm(x) and keys[norm(x)] >= 10)]
        assert out[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert LD.line_dedup(docs(spark, ["x"]).limit(0)).count() == 0


def test_shard_finds_members_only():
    rng = np.random.default_rng(0)
    h, fp = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    h[1] = h[0]  # one place, two fingerprints
    counts = rng.integers(10, 99, 5000)
    shard = LD.Shard(LD.build_shard(h, fp, counts))
    assert (shard.count(h, fp) == counts).all()
    assert (shard.count(h, fp + np.uint64(1)) == 0).all()


# ---- decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(C.UPPER, C.UPPER.lower())))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(n, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), sorted(found), bool(hit)


def test_decontaminate(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("ab bc cd de ef fg gh hi Éa éa".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((14, 12, 10, 9, 4, 1, 0, 30, 30))] + [(99, None), (7, "twice the same id")]
    pieces = [t.split() for _, t in items if t]
    texts = [None, "", "...", "A " * 40, "cd"]
    for _ in range(150):
        t = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(pieces)
            a = rnd.randint(0, max(0, len(p) - 1))
            t += p[a : a + rnd.randint(1, 20)] + [word() for _ in range(rnd.randint(0, 4))]
        texts.append("-".join(t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = by_id(decontaminate(docs(spark, texts + texts[5:7], n_hit=F.lit(1)), bench), "n_words", "n_hit", "n_items", "items", "contaminated")
    for i, t in enumerate(texts + texts[5:7]):
        assert out[i] == brute_hits(t, items), t
    clean = by_id(decontaminate(docs(spark, texts), bench.limit(0)), "n_hit", "contaminated")
    assert set(clean.values()) == {(0, False)}


def test_decontaminate_templated_items(spark):
    """Items that share a template share fingerprints; a document that holds it is held against each surrounding once."""
    from eventide.llm import decontaminate as D

    lead = " ".join(f"t{i}" for i in range(24))
    items = [(i, f"{lead} {i % 4} q{i % 7} end of the question") for i in range(60)] + [(100, "a a a a a a a a a a a b"), (101, "b a a a a a a a a a a a")]
    texts = [lead, f"x {lead} 2 q5 end of the question", f"{lead} 9", " ".join(lead.split()[:9]), "c a a a a a a a a a a a c", "b " + "a " * 11 + "b"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = by_id(decontaminate(docs(spark, texts), bench), "n_words", "n_hit", "n_items", "items", "contaminated")
    for i, t in enumerate(texts):
        assert out[i] == brute_hits(t, items), t
    marks = D._item_marks(bench.select("item_id", C.alnum_words(C.ascii_lower(C.whole("text"))).alias("w")), 10, 5)
    assert marks.select("mark").distinct().count() < marks.count() / 2
    assert marks.select("mark").distinct().count() == marks.select("k", "h", "least", "item_around").distinct().count()


def test_decontaminate_null_ids(spark):
    import corpus_pipeline as P

    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    df = spark.createDataFrame([(None, "x " + one), (None, "clean"), (1, two), (2, one + " " + two), (3, two + " y " + three), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, one), (None, two), (None, three)], "item_id long, text string")
    out = Counter((r.doc_id, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in decontaminate(df, bench).collect())
    assert out == Counter([(None, 12, 1, ("7",), True), (None, 0, 0, (), False), (1, 12, 1, (), True), (2, 24, 2, ("7",), True), (3, 24, 1, (), True), (4, 0, 0, (), False)])
    folder = C.new_folder(spark, "null-ids")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    assert [(r.doc_id, r.text) for r in P.drop_contaminated(spark, df, folder).orderBy("doc_id").collect()] == [(None, "clean"), (4, "clean")]


# ---- licenses


def test_license_scan(spark):
    texts = [None, "", "CC-BY and cc   by", "gnu General public license!", "ALL RIGHTS RESERVED all rights reserved", "released under the fine mit license", "Released under the MIT license.", "all rights", "cc", "x " * 3000 + "licensed under the apache license, version 2.0"]
    out = by_id(license_scan(docs(spark, texts, labels=F.lit(0))), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert out[0] == (0, 0, None, None, "", "", 0.0) == out[1]
    assert out[2] == (5, 2, 0, 3, "cc-by", "cc-by", 1.0)
    assert out[3][1:5] == (1, 1, 1, "gpl") and out[4][1:5] == (2, 0, 3, "reserved")
    assert out[6][4:6] == ("", "mit") and out[6][6] == 1.0
    assert out[7][1] == 0 and out[8][1] == 0 and out[9][5] == "apache" and out[9][0] == 3008
    assert out[5][5] == "" and 0 < out[5][6] < 0.8  # an edited copy is scored, and verified only from 0.8 on


def brute_license_score(words, template, gram=3, drift=2, block=10):
    """The best share of the template's words that hits on neighbouring diagonals, or long spans near each other, cover."""
    places = defaultdict(list)
    for t in range(len(template) - gram + 1):
        places[tuple(template[t : t + gram])].append(t)
    hits = defaultdict(set)
    for p in range(len(words) - gram + 1):
        for t in places.get(tuple(words[p : p + gram]), ()):
            hits[p - t].add(t)
    spans, last = [], None
    for diagonal in sorted(hits):
        if last is None or diagonal - last > drift:
            spans.append((set(), set()))
        last = diagonal
        spans[-1][0].update(t + k for t in hits[diagonal] for k in range(gram))
        spans[-1][1].update(diagonal + t for t in hits[diagonal])
    best = max((len(covered) for covered, _ in spans), default=0)
    chain, reached = set(), None
    for first, end, covered in sorted((min(at), max(at) + gram - 1, sorted(covered)) for covered, at in spans if len(covered) >= block):
        chain = set(covered) if reached is None or first - reached > len(template) else chain | set(covered)
        reached = end if reached is None else max(reached, end)
        best = max(best, len(chain))
    return best / len(template)


def test_moved_and_parted_licenses(spark):
    """Sentences in another order, and with other text between them, are still the licence; the same ones far apart, or
    only some of them, are not."""
    from eventide.llm.licenses import TEMPLATES, license_chains, license_spans

    words = dict(reversed(TEMPLATES))["zlib"].split()
    a, b, c = words[:40], words[40:80], words[80:]
    other = lambda n: [f"w{i}" for i in range(n)]
    n = len(words)
    texts = [[*b, *c, *a], [*c, *b, *a], [*a, *other(60), *b, *other(90), *c], [*a, *other(3 * n), *b, *other(3 * n), *c], [*b, *a], [*a, *a, *a], other(n), [*c, *a, *b, *other(5 * n), *words]]
    df = docs(spark, [" ".join(t) for t in texts])
    out = by_id(license_scan(df), "labels", "score")
    assert [out[i][0] for i in range(len(texts))] == ["zlib", "zlib", "zlib", "", "", "", "", "zlib"]
    for i, t in enumerate(texts):
        assert out[i][1] == pytest.approx(max(brute_license_score(t, w.split()) for _, w in TEMPLATES))
    rows = license_chains(license_spans(df.where("doc_id = 7"))).where("label = 'zlib' AND verified").orderBy("first_at").collect()
    assert [(r.first_at, r.last_at) for r in rows] == [(0, n - 1), (6 * n, 7 * n - 1)]


def test_edited_licenses(spark):
    """Whole licence texts, with a word in twenty-five left out, put in or changed, are found and verified."""
    from eventide.llm.licenses import TEMPLATES

    rnd, texts, labels = random.Random(31), [], []
    long = [(label, words.split()) for label, words in TEMPLATES if len(words.split()) > 60]
    for label, words in long:
        for _ in range(6):
            edited = list(words)
            for _ in range(len(words) // 25):
                i = rnd.randrange(len(edited))
                edited[i : i + 1] = rnd.choice(([], [edited[i], "x"], ["y"]))
            texts.append("Intro text. " + " ".join(edited).capitalize() + ".\nMore text follows")
            labels.append(label)
    texts += [" ".join(words[: len(words) // 2]) for _, words in long]  # half of one is not a licence
    out = by_id(license_scan(docs(spark, texts)), "labels", "score")
    found = [label in out[i][0].split(",") for i, label in enumerate(labels)]
    assert np.mean(found) > 0.9
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", t.lower())
        best = max(brute_license_score(words, w.split()) for _, w in TEMPLATES)
        base = any(f" {p} " in f" {' '.join(words)} " for p in ("cc by", "general public license", "all rights reserved"))
        assert out[i][1] == pytest.approx(1.0 if base else best)
    # isc and zlib have no short notice among the templates, so half of them has no label
    assert all(label not in out[len(labels) + k][0].split(",") for k, (label, _) in enumerate(long) if label in ("isc", "zlib"))


def test_license_scan_edges(spark):
    df = spark.createDataFrame([(None, "released under the mit license"), (1, "cc by"), (1, "cc by")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert Counter((r.doc_id, r.labels, r.score) for r in license_scan(df).collect()) == Counter([(None, "mit", 1.0), (1, "cc-by", 1.0), (1, "cc-by", 1.0)])
    assert license_scan(df.limit(0)).count() == 0


# ---- substrings


def brute_substrings(texts, n):
    seen, data = defaultdict(list), [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for x in range(len(b) - n + 1):
            seen[b[x : x + n]].append((i, x))
    gone = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, x in places:
                gone[i][x : x + n] = True
    return {i: (len(b), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()) if len(b) else 0, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for i, (b, g) in enumerate(zip(data, gone))}


@pytest.mark.parametrize("steps", [(24, 1), (64, 16, 4, 1), (1,)])
def test_substrings(spark, steps):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    base = [text(3000) for _ in range(3)]
    texts = [None, "", "abc", "a" * 399, "a" * 400, "a" * 401, "b" * 1500, "xyz" * 300, base[0], base[0][:1500] + text(100) + base[0][1500:], base[1], base[1], base[2][:2000], text(50) + base[2][100:520], text(50) + base[2][100:498] + "Q"]
    for _ in range(25):
        t = ""
        for _ in range(rnd.randint(1, 5)):
            s, i = rnd.choice(base), rnd.randint(0, 2500)
            t += s[i : i + rnd.randint(10, 900)] + text(rnd.randint(0, 30))
        texts.append(t)
    out = by_id(SS.substring_dedup(docs(spark, texts, n_spans=F.lit("x")), keep_bytes=False, steps=steps), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == brute_substrings(texts, 400)


def test_substrings_free_their_disk(spark, monkeypatch):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    base = text(3000)
    texts = [base, text(90) + base[300:1900], base[:1500] + text(80) + base[1500:], text(2000), None]
    folder, real, live = C.shared_folder(spark).removeprefix("file://"), C.written, []
    earlier = set(os.listdir(folder))
    tables = lambda: sorted(x.rpartition("-")[0] for x in set(os.listdir(folder)) - earlier if not x.startswith("."))
    monkeypatch.setattr(C, "written", lambda df, name: (real(df, name), live.append(tables()))[0])
    shuffles = lambda: set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*.data", recursive=True))
    old = shuffles()
    result = SS.substring_dedup(docs(spark, texts), keep_bytes=False)
    assert tables() == ["removed-spans"]
    assert live[-1] == ["anchors", "removed-spans", "told-anchors", "windows", "windows"] and max(map(len, live)) <= 7
    until = time.time() + 20
    while shuffles() - old and time.time() < until:  # files go a moment after the query
        time.sleep(0.2)
    assert not shuffles() - old
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert by_id(result, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(texts, 400)


def test_anchor_chunks_agree(monkeypatch):
    data = "".join(random.Random(1).choice("abcde ") for _ in range(20_000)).encode() + b"z" * 3000
    whole = SS.anchors(data, 400)
    monkeypatch.setattr(SS, "CHUNK", 700)
    assert (SS.anchors(data, 400) == whole).all()


# ---- bpe


def test_bpe_is_tiktoken(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=B.load_ranks(path), special_tokens={})
    rnd = random.Random(2)
    texts = [None, "", "a" * 3000, "aaab" * 500 + " \n\n x", " 　x\x85y", "<|endoftext|> it's", "日本語 123½", "👩‍👩‍👧", " " * 2000]
    texts += ["".join(rnd.choice("ab \n'sxyzéß0") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    texts += ["".join(chr(rnd.choice((rnd.randint(0, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF)))) for _ in range(40)) for _ in range(200)]
    out = by_id(B.bpe(docs(spark, texts, extra=F.lit(None).cast("long")), path, public.PATTERN), "n_tokens", "token_ids", "decoded_sha256")
    for i, t in enumerate(texts):
        assert list(out[i][1]) == real.encode_ordinary(t or "") and out[i][0] == len(out[i][1])
        assert out[i][2] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_dictionary_and_turnover(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=B.load_ranks(path), special_tokens={})
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(2, 9)))
    vocab = [word() for _ in range(300)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 200))) for _ in range(120)] + ["x" * 5000, "", None]
    # repeated rows over several partitions: the widespread pieces make the dictionary, and only as many as have room
    many = docs(spark, texts).unionByName(docs(spark, texts)).repartition(6)
    folder = B.learn_dictionary(many, path, public.PATTERN, "text", 100)
    learned = B._dictionary(folder)
    assert 50 < len(learned) < 150 and all(list(np.frombuffer(v, "<u4")) == real.encode_ordinary(k) for k, v in learned.items())
    out = B.bpe(many, path, public.PATTERN, dictionary=100).select("doc_id", "token_ids").collect()
    assert len(out) == 2 * len(texts) and all(list(r.token_ids) == real.encode_ordinary(texts[r.doc_id] or "") for r in out)
    assert B.bpe(many.limit(0), path, public.PATTERN).count() == 0
    # the same with blocks, layouts and memory so small that each of them turns over
    for name, value in (("BLOCK_CHARS", 500), ("LAYOUT", 60), ("REMEMBERED", 40), ("STREAMED", 300)):
        monkeypatch.setattr(B, name, value)
    import pyarrow as pa

    encoder = B.Encoder(path, public.PATTERN, learned)
    got = [list(np.frombuffer(x, "<u4")) for _, block in B._blocks(pa.array(texts)) for x in encoder.encode(block)]
    assert got == [real.encode_ordinary(t or "") for t in texts]


@pytest.mark.parametrize("layout", [40, 300, 1_000_000])
def test_bpe_of_very_long_pieces(monkeypatch, layout):
    """One piece without a break: cut where no token can stand, and laid out whole where there is no such place."""
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=B.load_ranks(path), special_tokens={})
    rnd = random.Random(layout)
    pieces = ["".join(rnd.choice(letters) for _ in range(4000)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "zqxjkv", "日本語漢字éß", "aé日")]
    pieces += ["a" * 4000, "ab" * 2000, "\x00" * 4000, " " * 4000, "=" * 3999, "qj" * 2000, "the" * 1000, "b"]
    monkeypatch.setattr(B, "LAYOUT", layout)
    monkeypatch.setattr(B, "GATHERED", 100)
    got = list(B.replay([x.encode() for x in pieces], path))
    assert len(got) == len(pieces)
    for piece, packed in zip(pieces, got):
        assert real.encode_ordinary(piece) == list(np.frombuffer(packed, "<u4")) and B.decode(packed, path) == piece.encode()
    for piece in pieces:
        parts = list(B._parts(piece.encode(), path))
        assert b"".join(parts) == piece.encode() and all(parts)
    # letters that no token holds side by side are cut to the layout
    assert layout > 4000 or max(map(len, B._parts(pieces[2].encode(), path))) <= layout


# ---- near duplicates


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("dense", [2_000, 3])
def test_near_dedup(spark, monkeypatch, dense):
    monkeypatch.setattr(MH, "DENSE", dense)
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice((5, 30, 120)))] for _ in range(12)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "a b c d", "a b c d e"]
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(w) // 20))):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append(" ".join(w))
    out = by_id(MH.near_dedup(docs(spark, texts)), "n_shingles", "component_id", "kept")
    assert out == brute_components(texts, 4, 80)


def test_near_dedup_edges(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r.doc_id, r.component_id, r.kept) for r in MH.near_dedup(df).collect())
    assert out == Counter({(None, 3, False): 1, (3, 3, True): 2, (None, None, True): 1, (5, 5, True): 1})
    assert MH.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("bands, rows", [(20, 5), (7, 3), (64, 2)])
def test_near_dedup_other_bandings(spark, bands, rows):
    rnd = random.Random(14)
    words = [[f"w{rnd.randrange(500)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:-1] + ["x"]) for w in words]
    out = by_id(MH.near_dedup(docs(spark, texts), bands=bands, rows=rows), "n_shingles", "component_id", "kept")
    assert out == brute_components(texts, 4, 80)


def test_near_dedup_recall(spark, sf):
    """Every exact link of the given documents, found by comparing all pairs that share a shingle."""
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()]
    order = sorted(rows, key=lambda r: r[0])
    want = brute_components([t for _, t in order], 4, 80)
    out = by_id(MH.near_dedup(C.table(spark, sf, "documents")), "n_shingles", "component_id")
    assert all(out[order[i][0]] == (n, order[root][0]) for i, (n, root, _) in want.items())


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**62, 200).astype(np.uint64)
    same = [(MH.sketch(x[:150] + np.uint64(k), 128) == MH.sketch(x[30:180] + np.uint64(k), 128)).mean() for k in range(30)]
    assert abs(np.mean(same) - 120 / 180) < 0.03


# ---- warc


def test_warc_round_trip(spark):
    big = "x" * 1000
    rows = [(1, "http://a/", big), (5, "http://b/ c", big), (3, None, big), (2, "u", "x" * 999), (4, "u", "x" * 999), (6, "u", None), (7, "u", "é" * 600), (8, "u", "é" * 600), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 5), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.warc_round_trip(df).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        rivals = [p for p, _, h in rows if h == html and p is not None]
        revisit = len(data) >= 1000 and page != max(rivals, default=page)
        assert out[page] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(rivals) if revisit else None)
    assert W.warc_round_trip(df.limit(0)).count() == 0


def test_normaliser_reads_one_stream_and_many_members():
    records = [W.record_bytes("response", i, "u", b"p" * n, "d", n, None) for i, n in enumerate((0, 10, 200_000, 3))]
    one = W._member(b"".join(records), 6)
    many = b"".join(W._member(r, 6) for r in records)
    for data in (one, many):
        source = iter([data[i : i + 100] for i in range(0, len(data), 100)])
        assert list(W.split_records(lambda _: next(source, b""))) == records
    assert W.parse_record(zlib.decompress(W._member(records[1], 1), 31))[1] == b"p" * 10
    with pytest.raises(ValueError):
        cut = iter([one[: len(one) // 2]])
        list(W.split_records(lambda _: next(cut, b"")))


# ---- main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site header words here</p></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&eacute;</h1><p><b>First &lt;line&gt;<br><p>Second&nbsp;  line</p><div class="ad">Buy this</div><form><input value="x">Send</form><script>track()</script>
<p>Third line of text</article><section id="comments"><p>reader says so and so</p></section><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(i, "u", PAGE) for i in range(3)] + [(10, "u", None), (11, "u", ""), (12, "u", "<p>only"), (13, "u", "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in MT.extract_main_text(df).collect()}
    assert out[0] == "Headé\nFirst <line>\nSecond line\nThird line of text"
    assert out[10] == out[11] == "" and out[12] == "only"
    assert MT.extract_main_text(df.limit(0)).count() == 0


def test_marks_only_widen_the_run():
    weights = {"<tag>": -0.1, "<word>": 1.0, "div": -3.0}
    text = lambda html: MT.main_text(html, weights)
    assert text("<main><p>lead words</p><article><p>a longer nested article with more words</p></article><p>tail words</p></main>") == "lead words\na longer nested article with more words\ntail words"
    assert text("<article><p>part one</p></article><p>between</p><article><p>part two is longer</p></article>") == "part one\nbetween\npart two is longer"
    assert text("<p>before it</p><article><p>marked words</p></article>") == "before it\nmarked words"
    far = "<div>one two</div>"  # scores below zero, so the run alone ends before it
    assert text(f"{far}<article><p>a b c</p>{far}</article>{far}") == "a b c\none two"


def test_pages_without_marks(spark, sf):
    """Weights from half of the given pages; of the other half, whose marks are taken out, the text that they marked."""
    pages = C.table(spark, sf.replace("0.001", "0.01"), "pages").where("html IS NOT NULL")
    half = F.pmod(F.xxhash64(F.lit(3), "page_id"), F.lit(2)) == 0
    weights = MT.learn(pages.where(half))
    f1, exact = [], 0
    for html in (r.html for r in pages.where(~half).select("html").collect()):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        want = MT.main_text(f"<article>{inner}</article>", weights)
        for tag in ("div", "section", "span"):
            got = MT.main_text(re.sub(r"<(/?)article>", rf"<\1{tag}>", html), weights)
            both = sum((Counter(got.split()) & Counter(want.split())).values())
            f1.append(2 * both / max(1, len(got.split()) + len(want.split())))
            exact += got == want
    assert len(f1) > 200 and np.mean(f1) > 0.95 and exact > 0.9 * len(f1)


@pytest.mark.parametrize("unit, times", [("<a ", 350_000), ('<a "', 250_000), ("<!x", 350_000), ("<article>", 110_000), ("<b>x</i>", 120_000), ("<", 1_000_000), ("<p>", 330_000), ("<a x=\"<b y='", 80_000)])
def test_long_pages_take_linear_time(unit, times):
    began = time.process_time()
    MT.main_text("<p>some words</p>" + unit * times, {"<tag>": -1.0, "<word>": 1.0})
    assert time.process_time() - began < 6  # a MB; going back over the page would take hours


def test_pieces():
    html = """a<b class="x>y" id=z>c</b ><!-- <p> --><br/>d < e <i f<u>g</u>it's<p t=o'clock>h<!DOCTYPE q></>k<script>"<p>"</script>l<em"""
    assert [x for x in MT.pieces(html) if x[0] != "text"] == [("open", "b", ' class="x>y" id=z'), ("close", "b", ""), ("open", "br", "/"), ("open", "u", ""), ("close", "u", ""), ("open", "p", " t=o'clock"), ("open", "script", "")]
    assert "".join(x[2] for x in MT.pieces(html) if x[0] == "text") == "acd < e <i fgit'shkl<em"


def test_main_text_loses_no_tail_and_no_name_decides_alone(spark):
    weights = MT.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert MT.main_text("<div>Hello<b>bold</b> world&amp;co</div>", weights) == "Helloboldworld&co".replace("world", " world")
    words = "A history of clubs and unions, told by those who were there. "
    assert MT.main_text(f'<article><p>{words}</p><p class="social-history">{words}</p></article>', weights) == f"{words.strip()}\n{words.strip()}"
    assert MT.main_text(f'<body><p>{words * 3}</p><kbd>x</kbd> tail<unseen>y</unseen> end</body>', weights).endswith("x taily end")
    # what names weigh is learned: this one stands outside of main text only
    pages = spark.createDataFrame([(i, f'<body><div class="zzq-7">{words}</div><article><p class="lead">{words}</p></article></body>') for i in range(40)], "page_id long, html string")
    learned = MT.learn(pages)
    assert learned[".zzq"] < -2 and learned[".lead"] > 2
    assert MT.main_text(f'<article><p>{words}</p><div class="zzq-7">{words}</div><p class="lead">{words}</p></article>', learned) == f"{words.strip()}\n{words.strip()}"
    assert "club" not in MT.main_text(f'<article><p>main words here</p><div class="comments">{words}</div></article>', weights)


def test_main_text_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("x")})
    out = MT.extract_main_text(df).collect()
    assert len(out) == 3 and len({(r.text, r.n_chars) for r in out}) == 1 and out[0].n_chars == len(out[0].text)


def test_best_run():
    assert MT.best_run([-1, 2, -1, 3, -5, 4]) == (1, 4) and MT.best_run([-1, 0]) == (0, 0) and MT.best_run([]) == (0, 0)


# ---- quality


def test_quality_rules_counts(spark):
    rnd = random.Random(6)
    texts = [None, "", "a b c d e f g h " * 6, "#$% x\nx\n x\n\nx", " ".join(str(i) for i in range(30)), "é" * 10]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    out = by_id(quality_rules(docs(spark, texts), labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        spots = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(spots))
        assert out[i] == (*want, len(w) < 20 or 100 * len(spots) > 30 * len(w))


def brute_scores(texts, trusted, buckets):
    """Mean log ratio of each text, from counts over words and pairs of words in plain Python."""
    import xxhash

    def terms(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [x % buckets for x in [*h, *map(pair, h, h[1:])]]

    raw, good = (Counter(x for t in part for x in terms(t)) for part in (texts, [t for i, t in enumerate(texts) if i in trusted]))
    weight = lambda x: math.log((good[x] + 1) / (good.total() + buckets)) - math.log((raw[x] + 1) / (raw.total() + buckets))
    return [np.mean([weight(x) for x in terms(t)]) if terms(t) else None for t in texts]


@pytest.mark.parametrize("trusted", [{0, 3, 5, 8, 13}, set()])
def test_quality_scores_by_brute_force(spark, trusted):
    rnd = random.Random(16)
    words = [f"w{i}é" for i in range(40)]
    texts = [" ".join(rnd.choice(words[: 15 if i in (0, 3, 5, 8, 13) else 40]) for _ in range(rnd.randint(15, 60))) for i in range(20)] + [None, "", "one", "same text " * 15, "same text " * 15]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(1, 1, 1), (2, 0, 0), (99, 1, None)], "doc_id long, quality int, toxic int")
    want = brute_scores(texts, trusted, 1 << 12)
    threshold = sorted(x for x in want if x is not None)[12]  # a tie with the threshold is kept
    for small in (250_000, 0):
        weights = log_ratios(docs(spark, texts), labels, buckets=1 << 12, small=small)
        assert weights.count() == 1 << 12
    out = by_id(quality_rules(docs(spark, texts, kept=F.lit("clash")), labels, buckets=1 << 12, threshold=threshold - 1e-9), "score", "base_failed", "kept")
    for i, w in enumerate(want):
        assert (out[i][0] is None) == (w is None) and (w is None or out[i][0] == pytest.approx(w, abs=1e-9))
        assert out[i][2] == (not out[i][1] and w is not None and w >= threshold - 1e-9)
    assert any(k for _, _, k in out.values()) and quality_rules(docs(spark, texts).limit(0), labels).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows with a null id, and rows that are repeated as a whole, have results of their own in every operator on documents."""
    one, two = (" ".join(f"{c}{i}" for i in range(90)) for c in "ab")
    rows = [(None, one), (None, two), (1, one), (1, one), (2, two + " tail"), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count = lambda out, *cols: Counter((r.doc_id, *(r[c] for c in cols)) for r in out.collect())
    brute = brute_substrings([t for _, t in rows], 400)
    assert count(SS.substring_dedup(df), "n_bytes", "n_removed", "kept_sha256") == Counter((i, brute[k][0], brute[k][1], brute[k][3]) for k, (i, _) in enumerate(rows))
    assert SS.substring_dedup(df.limit(0)).count() == 0
    lines = LD.line_dedup(df.unionByName(df).unionByName(df), min_docs=9)
    assert count(lines, "n_dropped") == Counter({(None, 1): 3, (None, 0): 3, (1, 1): 6, (2, 0): 3, (3, 0): 6, (4, 0): 3})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert count(quality_rules(df, labels), "n_words") == Counter({(None, 90): 2, (1, 90): 2, (2, 91): 1, (3, 0): 2, (4, 0): 1})
    pages = spark.createDataFrame([(7, "u", "x" * 1500)] * 2 + [(8, "u", "x" * 1500), (None, "v", None)], "page_id long, url string, html string")
    records = Counter((r.page_id, r.record_type, r.refers_to) for r in W.warc_round_trip(pages).collect())
    assert records[(8, "response", None)] == 1 and records[(7, "revisit", 8)] == 2 and records.total() == 4


def test_every_trusted_document_is_counted(spark):
    df = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("text"))
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    off = F.max(F.abs(F.col("weight")))
    assert trusted_ids(labels).count() == 25_000
    assert log_ratios(df, labels.unionByName(labels), buckets=64).agg(off).first()[0] == 0  # all are trusted: both sides agree


def test_classifier_on_held_out_labels(spark, sf):
    from eventide.llm.quality_classifier import quality_scores

    sf = sf.replace("0.001", "0.01")
    d, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, "s", -5)], d.schema)
    scored = quality_scores(d.unionByName(odd), labels.where(~held))
    assert scored.count() == d.count() + 2 and scored.where("kept IS NULL").count() == 0
    r = scored.join(labels.where(held), "doc_id").toPandas()
    clean = r[(r.quality == 1) & (r.toxic == 0)]
    assert clean.kept.mean() > 0.95 and r[r.quality == 0].kept.mean() < 0.3


def two_view_corpus(spark, n=1500):
    """Documents whose class shows in half of the texts, and in the source of the other half."""
    rnd, rows, labels = random.Random(21), [], []
    for i in range(n):
        y, in_text = i % 2, rnd.random() < 0.6
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30)]
        if in_text:
            words[rnd.randrange(30)] = rnd.choice(("fine", "good", "nice") if y else ("bad", "spam", "junk"))
        source = f"s{y}" if not in_text or rnd.random() < 0.7 else "s9"
        rows.append((i, " ".join(words), "en", source, 100))
        if i < 700:
            labels.append((i, y, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_views_teach_each_other(spark):
    from eventide.llm import quality_classifier as QC

    d, labels = two_view_corpus(spark)
    alone, taught = (QC.co_train(d, labels, rounds=r) for r in (0, 1))
    assert alone.exchanged == {} and all(min(taught.exchanged[0, view]) > 20 for view in ("text_x", "meta_x")), taught.exchanged
    held = lambda model: [(r.score, r.kept, r.doc_id % 2) for r in QC.score_all(d.where("doc_id >= 700"), model).select("doc_id", "score", "kept").collect()]
    before, after = held(alone), held(taught)
    assert sorted(x[0] for x in before) != sorted(x[0] for x in after)  # what was passed on changes the fits
    right = [np.mean([kept == bool(y) for _, kept, y in rows]) for rows in (before, after)]
    assert right[1] > 0.95 and right[1] >= right[0] - 0.01


def test_confident_cuts():
    from eventide.llm.quality_classifier import confident_cuts

    held = [(float(i), 1.0 if i > 60 or i == 3 else 0.0) for i in range(100)]
    assert confident_cuts(held, 1.0) == {1.0: 61.0}  # the lowest rows hold an accepted one
    cuts = confident_cuts(held, 0.9, least=10)
    assert cuts[1.0] == 57.0 and 50 < cuts[0.0] < 70
    assert confident_cuts([(0.0, 1.0)] * 50, 0.9) == {} and confident_cuts([], 0.9) == {}


def test_classifier_edges(spark):
    from eventide.llm.quality_classifier import quality_scores

    d, labels = two_view_corpus(spark, 400)
    df = d.withColumns({"score": F.lit("clash"), "kept": F.lit(7)})
    again = df.where("doc_id < 5")
    out = quality_scores(df.unionByName(again), labels.unionByName(labels.limit(3)), rounds=1)
    rows = Counter((r.doc_id, r.score, r.kept) for r in out.select("doc_id", "score", "kept").collect())
    assert len(rows) == 400 and sum(rows.values()) == 405 and {k[0] for k, n in rows.items() if n == 2} == set(range(5))
    assert quality_scores(d.limit(0), labels, rounds=1).count() == 0
    assert {r.kept for r in quality_scores(d, labels.limit(0), rounds=1).select("kept").distinct().collect()} == {True}


@pytest.mark.parametrize("quality", [1, 0])
def test_labels_of_one_class_keep_all(spark, sf, quality):
    from eventide.llm.quality_classifier import quality_scores

    d = C.table(spark, sf, "documents")
    labels = d.select("doc_id", F.lit(quality).alias("quality"), F.lit(0).alias("toxic")).limit(80)
    out = quality_scores(d, labels, rounds=1).select("score", "kept").distinct().collect()
    assert [tuple(r) for r in out] == [(0.5, True)]


# ---- pipeline


def test_pipeline_from_end_to_end(spark, sf):
    """Each stage against a plain version of it on what the stage before kept."""
    import corpus_pipeline as P
    import public_tokenizers
    import tiktoken

    from eventide.llm.quality_classifier import quality_scores

    stages, d, labels = dict(P.STAGES), C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = C.written(stages["quality classifier"](spark, d, sf), "one")
    scored = {r.doc_id for r in quality_scores(d, labels).where("score >= 0.5").collect()}
    assert set(rows(kept)) == scored and kept.columns == d.columns and 0 < len(scored) <= d.count()
    before, lines = rows(kept), C.written(stages["line dedup"](spark, kept, sf), "two")
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(C.UPPER, C.UPPER.lower()))
    found = Counter(k for t in before.values() for k in {norm(x) for x in (t or "").split("\n")})
    after = rows(lines)
    assert after == {i: t if t is None else "\n".join(x for x in t.split("\n") if not norm(x) or found[norm(x)] < 10) for i, t in before.items()}
    near = C.written(stages["minhash near-dedup"](spark, lines, sf), "three")
    order = sorted(after.items())
    assert set(rows(near)) == {order[i][0] for i, (_, _, first) in brute_components([t for _, t in order], 5, 80).items() if first}
    clean = C.written(stages["benchmark decontamination"](spark, near, sf), "four")
    items = [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()]
    windows = {w for _, t in items for w in brute_windows(t)}
    assert set(rows(clean)) == {i for i, t in rows(near).items() if not windows & brute_windows(t)} and all(len(w) == 10 for w in windows)
    ids = {r.doc_id: list(r.token_ids) for r in stages["byte-level bpe"](spark, clean, sf).collect()}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load_ranks(path), special_tokens={})
    assert ids == {i: real.encode_ordinary(t or "") for i, t in rows(clean).items()}
    made = C.new_folder(spark, "x").rsplit("/", 1)[0].replace("file://", "")
    tables = set(os.listdir(made))
    assert {r.doc_id for r in P.run(spark, sf).collect()} == set(ids)
    assert len(set(os.listdir(made)) - tables) == 1  # what the stages wrote for themselves is gone


def brute_windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(C.UPPER, C.UPPER.lower())))
    return {tuple(w[i : i + n]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    body = " ".join(word() for _ in range(200))
    rows = [(i, f"shared line\n{' '.join(word() for _ in range(60))}", "en", "s", 1) for i in range(12)] + [(20, body, "en", "s", 1), (21, body + " more", "en", "s", 1), (22, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(P.STAGES)
    lines = stages["line dedup"](spark, df, "")
    assert lines.columns == df.columns and lines.where("text LIKE '%shared line%'").count() == 0 and lines.where("doc_id = 22 AND text IS NULL").count() == 1
    near = stages["minhash near-dedup"](spark, df.unionByName(df.where("doc_id = 20")), "")
    assert sorted(r.doc_id for r in near.collect()) == [*range(12), 20, 22]
    assert [k for k, _ in P.STAGES] == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "byte-level bpe"]
