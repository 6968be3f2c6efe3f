"""Benchmark decontamination by winnowing: which words of a document lie in a passage of a benchmark item.

A window is ``window`` consecutive words of an item.  With k-grams of ``gram`` words, every such window holds
``window - gram + 1`` of them, and the smallest hash among those is kept as a fingerprint.  Equal windows keep the same
fingerprint at the same place, so joining fingerprints misses no shared window; extending a hit to both sides by
comparing words finds the windows that hold it.  An item shorter than a window is one window: its first ``gram`` words (all
of them, where it has fewer) are its fingerprint, and documents keep every k-gram of such lengths in the same pass.
DataFrame functions only.

Words are compared by 64-bit hash.  Documents send (hash, place) of their fingerprints to the join; only those that meet a
benchmark fingerprint fetch the words around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def _around(hashes: Column, at: Column, window: int, gram: int) -> Column:
    """The hashes from window - gram words before place at (from 0) to a window behind it, null beyond the ends."""
    return F.transform(F.sequence(at - (window - gram), at + (window - 1)), lambda p: F.when(p >= 0, F.get(hashes, p)))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, k: int) -> Column:
    """Of each run of k words, a 32-bit hash packed over its place, so that a minimum is the smallest, leftmost one."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda x, i: F.shiftleft(F.hash(x, *(F.get(hashes, i + j) for j in range(1, k))).cast("long"), 32) + i)


def _winnowed(hashes: Column, window: int, gram: int) -> Column:
    """The distinct smallest k-grams of the windows; empty where there are fewer words than a window."""
    slack = window - gram

    def least(k: Column) -> Column:
        count = F.greatest(F.size(k) - slack, F.lit(0))
        first = F.slice(k, F.lit(1), count)
        return F.array_distinct(F.transform(first, lambda x, i: F.least(x, *(F.get(k, i + j) for j in range(1, slack + 1)))) if slack else first)

    return C.let(_grams(hashes, gram), least)


def _unpacked(k, packed: str) -> list[Column]:
    return [F.lit(k).alias("k") if isinstance(k, int) else k, F.shiftright(packed, 32).cast("int").alias("h"), F.col(packed).bitwiseAND(0x7FFFFFFF).cast("int").alias("at")]


def _fingerprints(rows: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """rows (..., w) with a row (k, h, at) for each fingerprint in place of w, k-grams of the short lengths included."""
    kept = [c for c in rows.columns if c != "w"]
    if not short:
        return rows.select(*kept, F.explode(C.let(_hashed(F.col("w")), lambda h: _winnowed(h, window, gram))).alias("x")).select(*kept, *_unpacked(gram, "x"))
    every = lambda h: F.array(
        *(F.struct(F.lit(n).alias("k"), _grams(h, n).alias("xs")) for n in short),
        *([] if gram in short else [F.struct(F.lit(gram).alias("k"), _winnowed(h, window, gram).alias("xs"))]),
    )
    lists = rows.select(*kept, F.inline(C.let(_hashed(F.col("w")), every)))
    return lists.select(*kept, "k", F.explode("xs").alias("x")).select(*kept, *_unpacked(F.col("k"), "x"))


def _item_marks(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(k, h, item_id, least, item_around, mark): the fingerprints of the items, with the words around and the least run that
    makes a window; mark names what a document is held against, whichever items have it."""
    hashed = items.select("item_id", _hashed(F.col("w")).alias("hs"))
    size = F.size("hs")
    long = hashed.where(size >= window).select("item_id", "hs", F.lit(window).alias("least"), F.explode(_winnowed(F.col("hs"), window, gram)).alias("x"))
    marks = long.select(*_unpacked(gram, "x"), "item_id", "hs", "least")
    for k in range(1, min(gram, window - 1) + 1):
        of_size = (size >= k) & (size < window) if k == gram else size == k
        first = hashed.where(of_size).select("item_id", "hs", size.alias("least"), F.element_at(_grams(F.col("hs"), k), 1).alias("x"))
        marks = marks.unionByName(first.select(*_unpacked(k, "x"), "item_id", "hs", "least"))
    found = marks.select("k", "h", "item_id", "least", _around(F.col("hs"), F.col("at"), window, gram).alias("item_around")).distinct()
    return found.withColumn("mark", C.text_key(F.col("k"), F.col("h"), F.col("least"), F.transform("item_around", lambda x: F.coalesce(x, F.lit(0)))))  # a hash passes over nulls


def _worded(texts: DataFrame) -> DataFrame:
    """texts (..., t) with an array of words w in place of t; explode() of one array keeps the split from being merged into
    its many uses."""
    kept = [c for c in texts.columns if c != "t"]
    return texts.select(*kept, F.explode(F.array(C.alnum_words(C.ascii_lower(F.col("t"))))).alias("w"))


def _runs(texts: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, key, item_id, a, b): runs a..b of document words that hold a window of an item."""
    slack = window - gram
    marks = C.written(_item_marks(items, window, gram), "benchmark-marks")
    short = [r[0] for r in marks.where(F.col("least") < window).select("k").distinct().collect()]  # at most gram numbers
    found = _fingerprints(_worded(texts), window, gram, sorted(short)).join(marks.select("k", "h").distinct(), ["k", "h"], "left_semi")
    spots = found.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("k", "h", "at")).alias("spots"))
    spots = C.written(spots, "benchmark-spots")
    # the texts meet their spots by a shuffle at every size; the spots, which grow with the corpus, are the hashed side
    met = texts.join(spots.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    asked = _worded(met.select("doc_id", "key", "spots", "t"))
    around = asked.select("doc_id", "key", F.explode(C.let(_hashed(F.col("w")), lambda h: F.transform("spots", lambda s: F.struct(s["k"].alias("k"), s["h"].alias("h"), s["at"].alias("at"), _around(h, s["at"], window, gram).alias("around"))))).alias("s"))
    # items of one template share fingerprints and what lies around them: a document is held against that once, not per item
    pairs = around.select("doc_id", "key", "s.*").join(marks.select("k", "h", "least", "item_around", "mark").distinct(), ["k", "h"])
    same = F.zip_with("around", "item_around", lambda a, b: F.coalesce(a == b, F.lit(False)))
    run = lambda part: C.let(F.array_position(part, F.lit(False)), lambda p: F.when(p == 0, F.size(part).cast("long")).otherwise(p - 1))
    sized = pairs.select("doc_id", "key", "mark", "k", "least", "at", same.alias("same"))
    left = run(F.reverse(F.slice("same", 1, slack))) if slack else F.lit(0).cast("long")
    sized = sized.withColumn("left", left).withColumn("right", run(F.slice("same", slack + 1, window)))
    held = sized.where((F.col("right") >= F.col("k")) & (F.col("left") + F.col("right") >= F.col("least"))).select("doc_id", "key", "mark", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("right") - 1).alias("b"))
    return held.join(marks.select("mark", "item_id").distinct(), "mark").drop("mark")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, key, n_hit, n_items, items) of every distinct (doc_id, text) that holds an item's window; see decontaminate()."""
    texts = docs.select("doc_id", C.text_key(C.whole(text)).alias("key"), C.whole(text).alias("t"))
    items = benchmark.select(F.col("item_id"), C.alnum_words(C.ascii_lower(C.whole("text"))).alias("w")).where(F.size("w") > 0)
    runs = C.written(_runs(texts, items, window, gram), "benchmark-runs")  # two aggregations read it
    by_item = runs.groupBy("doc_id", "key", "item_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    # an item's runs in a document become words once per item, then distinct words count
    spots = by_item.select("doc_id", "key", F.explode("runs").alias("r")).distinct().select("doc_id", "key", F.explode(F.sequence("r.a", "r.b")).alias("p"))
    words = spots.distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    ids = by_item.groupBy("doc_id", "key").agg(named.alias("items"), (F.size(named) + F.max(F.col("item_id").isNull().cast("int"))).alias("n_items"))
    same = F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("w.key") == F.col("i.key"))
    return words.alias("w").join(ids.alias("i"), same).select("w.*", "i.n_items", "i.items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings) and contaminated.

    Null and empty texts have no words and no hits; repeated rows give equal results on each; an item
    without words is left out; items with a null item_id hit like others, count together as one in n_items and have no
    name in items; an empty benchmark leaves every document clean; extra columns pass through, and those
    called like the new ones are replaced.  A null doc_id is a value like another.
    """
    new = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    found = C.written(contamination(docs, benchmark, text, window, gram).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n_hit", "n_items", "items"), "contamination")
    kept = [c for c in docs.columns if c not in new]
    n_words = C.n_parts(C.whole(text), C.NOT_ALNUM)
    keyed = docs.select(*kept, C.text_key(C.whole(text)).alias("__key"), n_words.alias("n_words"))
    joined = keyed.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.__id")) & (F.col("d.__key") == F.col("f.__key")), "left")
    return joined.select(
        *(F.col(f"d.{c}").alias(c) for c in [*kept, "n_words"]),
        F.coalesce("f.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("f.n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
        F.col("f.n_hit").isNotNull().alias("contaminated"),
    )
