"""Quality rules: counted heuristics, then a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words and pairs of words are hashed into a fixed number of buckets.  Two smoothed multinomials over those buckets are
counted, one over every document and one over trusted documents; a document's score is the mean log ratio of its terms,
so length does not matter, and ``score >= threshold`` keeps it.  DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16
SYMBOLS = r"[#*$%&|<>]"


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(hashes: Column, apart: int) -> Column:
    """The hash of each element with the one ``apart`` places later: pairs of words, then of pairs, and so on."""
    return F.transform(F.slice(hashes, F.lit(1 + apart), F.size(hashes)), lambda x, i: F.xxhash64(F.get(hashes, i), x))


def repeated_words(pairs: Column, window: int = 8) -> Column:
    """How many words lie in a window of so many words, a power of two, that stands twice or more in the text, its first
    place included; ``pairs`` are the hashes of neighbouring words.

    Windows are compared by 64-bit hash.  Sorting (hash, place) brings equal windows together, so the work is n log n, and
    only a text with equal windows is sorted.
    """

    def grams(h: Column, have: int) -> Column:
        return counted(h) if have == window else C.let(joined(h, have), lambda x: grams(x, 2 * have))

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long"))

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = C.let(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return C.let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(F.size(pairs) >= window, grams(pairs, 2)).otherwise(F.lit(0).cast("long"))


def rule_counts(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(C.SPACE_CHARS))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.concat_ws("", words)).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": C.let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeated_words(pairs),
    }


def terms(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every word and of every pair of neighbouring words."""
    return C.let(hashed(words), lambda h: F.concat(_bucketed(h, buckets), _bucketed(joined(h, 1), buckets)))


def _bucketed(hashes: Column, buckets: int) -> Column:
    return F.transform(hashes, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every labelled row of quality 1 that is not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS, small: int = 250_000) -> DataFrame:
    """(bucket, weight): log of the trusted over the raw share of each bucket, one added to every count.

    The raw counts cover every document and the trusted counts every trusted one.  The ids are counted first: up to
    ``small`` of them are broadcast, more make a shuffled join with the ids as the hashed side.
    """
    ids = C.written(trusted_ids(labels).withColumn("trust", F.lit(1)), "trusted-ids")
    ids = F.broadcast(ids) if ids.count() <= small else ids.hint("shuffle_hash")
    texts = docs.select("doc_id", C.whole(text).alias("t"))
    # no id matches null, and rows without one would all meet in one task
    flagged = texts.where("doc_id IS NOT NULL").join(ids, "doc_id", "left").select("trust", "t").unionByName(texts.where("doc_id IS NULL").select(F.lit(None).cast("int").alias("trust"), "t"))
    counted = (
        flagged.select(F.coalesce("trust", F.lit(0)).alias("trust"), F.explode(terms(C.space_words(F.col("t")), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("trust").alias("good"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    counts = C.written(every, "term-counts")
    raws, goods = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()  # two numbers
    return counts.select("bucket", F.log((F.col("good") + 1) / F.lit(float(goods + buckets)) / ((F.col("raw") + 1) / F.lit(float(raws + buckets)))).alias("weight"))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = -0.1, min_words: int = 20, max_repeat_percent: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """doc_id with the counts, base_failed, score (mean log ratio; null without words) and kept.

    Every input row gives one row, repeated rows and null ids too; a null or empty text has no words and fails the base
    rule; with no trusted row at all the ratios only say how the corpus is spread, and hardly move; an empty table gives
    an empty one; other columns are ignored.
    """
    weights = log_ratios(docs, labels, text, buckets).orderBy("bucket").select("weight").collect()  # ``buckets`` numbers
    table = F.from_json(F.lit(json.dumps([r[0] for r in weights])), "array<double>")  # folded into a constant of the plan
    named = docs.select("doc_id", C.whole(text).alias("t"))
    # explode() of one array of words stands between the split and its many uses, so the split runs once a row
    split = named.select("doc_id", "t", F.explode(F.array(C.space_words(F.col("t")))).alias("w"))
    total = lambda hashes, start: F.aggregate(hashes, start, lambda a, x: a + F.get(table, F.pmod(x, F.lit(buckets)).cast("int")))

    def facts(h: Column, p: Column) -> Column:
        score = F.when(F.size(h) > 0, total(p, total(h, F.lit(0.0))) / (F.size(h) + F.size(p)))
        return F.struct(*(c.alias(k) for k, c in rule_counts(F.col("t"), F.col("w"), p).items()), score.alias("score"))

    both = F.inline(F.array(C.let(hashed(F.col("w")), lambda h: C.let(joined(h, 1), lambda p: facts(h, p)))))
    scored = split.select("doc_id", both)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select(*counts, failed.alias("base_failed"), "score", (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"))
