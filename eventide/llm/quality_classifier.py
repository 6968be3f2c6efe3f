"""Quality classifier by co-training on two views: what a text says, and what its metadata say.

1. A lexicon is taken from at most ``labelled`` labelled rows: the words whose presence tells accepted from rejected best.
2. Every document gets the features of both views in one pass: presence of the lexicon's words and measures of style;
   hashed language and source, and lengths.
3. Each view trains a logistic regression on the labelled rows.  In each round it scores every unlabelled document, and
   passes its most confident pseudo-labels, at most ``exchange`` per class, to the other view's training rows.  Confident
   is what lies beyond a cut at which ``confident`` of the held-out labelled rows of the predicted class are right, for
   either class and view by itself; a view without such a cut passes nothing.
4. Each view is calibrated on labelled rows that it was never fitted on, and the two log-odds are added, less the prior's:
   the views are taken to be independent within a class, as co-training assumes.

A row is accepted if its quality is 1 and it is not toxic.  The fits run in Spark ML on bounded rows; scoring covers every
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
STYLE, LANGS, SOURCES = 12, 8, 32


def text_features(text: str | None, lexicon: dict[str, int]) -> np.ndarray:
    x = np.zeros(STYLE + len(lexicon), np.float32)
    text = text or ""
    chars, tokens, lines = len(text) or 1, text.split(), text.split("\n")
    n = len(tokens) or 1
    words = set(_WORD.findall(text.lower()))
    pairs = set(zip(tokens, tokens[1:]))
    x[:STYLE] = (
        len(_SYMBOL.findall(text)) / chars, text.count("!") / n, sum(map(str.isupper, tokens)) / n, text.count("|") / n, len(words) / n,
        (len(pairs) + 1) / n, 1 - len(set(lines)) / len(lines), len("".join(tokens)) / n / 10, len(lines) / n, log1p(n), n < 20,
        sum(map(str.isdigit, text)) / chars,
    )
    for word in words & lexicon.keys():
        x[STYLE + lexicon[word]] = 1
    return x


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(LANGS + SOURCES + 3, np.float32)
    x[crc32((lang or "").encode()) % LANGS] = 1
    x[LANGS + crc32((source or "").encode()) % SOURCES] = 1
    size = log1p(max(n_chars or 0, 0))
    x[LANGS + SOURCES :] = (size, size * size / 10, n_chars is None)
    return x


def accepted(labels: DataFrame) -> DataFrame:
    """(doc_id, y): 1 where quality is 1 and toxic is not; a document with several labels needs all of them to agree."""
    y = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(y).alias("y"))


def learn_lexicon(sample: DataFrame, size: int, least: int = 5) -> list[str]:
    """The words whose presence differs most between the classes of (text, y), by a signed-root log-likelihood measure."""
    rows = sample.select("y", F.explode(F.array_distinct(C.alnum_words(F.lower(C.whole("text"))))).alias("word"))
    counts = rows.groupBy("word").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).where(F.col("good") + F.col("bad") >= least)
    total = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    goods, bads = (total[0] or 0) + 1.0, (total[1] or 0) + 1.0
    p, q = (F.col("good") + 0.5) / goods, (F.col("bad") + 0.5) / bads
    return [r[0] for r in counts.orderBy(F.desc(F.abs(F.log(p / q)) * F.sqrt(F.least(p * goods, q * bads) + F.abs(p - q) * F.lit(min(goods, bads)))), "word").limit(size).select("word").collect()]


def featured(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, text_x, meta_x) of every document."""
    places = {w: i for i, w in enumerate(lexicon)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source, chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([text_features(t, places) for t in text], kind), pa.array([meta_features(*m) for m in zip(lang, source, chars)], kind)],
                names=["doc_id", "text_x", "meta_x"],
            )

    columns = docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return columns.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_x array<float>, meta_x array<float>")


class View:
    """A view's regression with its calibration: probability = 1 / (1 + exp(-(slope * margin + shift)))."""

    def __init__(self, name: str):
        self.name, self.weights, self.bias, self.slope, self.shift = name, None, 0.0, 1.0, 0.0

    def fit(self, rows: DataFrame, calibrate: DataFrame) -> None:
        model = _regression(rows, self.name, 0.001)
        if model is None:
            return
        self.weights, self.bias = model.coefficients.toArray(), float(model.intercept)
        line = _regression(calibrate.select("y", F.array(self.margin()).alias("m")), "m", 0.0)
        if line is not None:
            self.slope, self.shift = max(0.0, float(line.coefficients[0])), float(line.intercept)

    def margin(self):
        """The margin as a column."""
        if self.weights is None:
            return F.lit(0.0)
        w = F.lit([float(v) for v in self.weights])
        return F.aggregate(F.zip_with(self.name, w, lambda x, v: x * v), F.lit(self.bias), lambda a, x: a + x)

    def probability(self):
        return 1 / (1 + F.exp(-self.odds()))

    def odds(self):
        """The calibrated log-odds as a column."""
        return self.margin() * self.slope + self.shift

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.bias) * self.slope + self.shift if self.weights is not None else np.full(len(x), self.shift)


def _regression(rows: DataFrame, features: str, penalty: float):
    """None where the rows do not hold both classes."""
    vectors = rows.select("y", array_to_vector(F.col(features).cast("array<double>")).alias("x"))
    seen = vectors.agg(F.min("y"), F.max("y")).first()
    if seen[0] == seen[1]:
        return None
    return LogisticRegression(featuresCol="x", labelCol="y", maxIter=60, regParam=penalty, elasticNetParam=0.0).fit(vectors)


def confident_cuts(held: list[tuple[float, float]], confident: float, least: int = 20) -> dict[float, float]:
    """For each class the log-odds from which on a held-out row of (log-odds, y) is right with that share; the farthest-
    reaching cut with ``least`` rows or more beyond it.  A class without one is left out, as is one whose plain share is
    that high already: nothing would be learned about it."""
    cuts = {}
    for y, sign in ((1.0, 1.0), (0.0, -1.0)):
        rows = sorted(((sign * odds, label == y) for odds, label in held), reverse=True)
        right = 0
        for n, (odds, hit) in enumerate(rows, 1):
            right += hit
            # equal log-odds fall on the same side
            if n >= least and right >= confident * n and (n == len(rows) or rows[n][0] < odds) and n < len(rows):
                cuts[y] = sign * odds
    return cuts


class CoTrained:
    """The lexicon, the two views, the log-odds that both of them hold (the prior's, 0 unless both were fitted), and the
    pseudo-labels that were passed on: exchanged[round, view that gave them] = (rejected, accepted)."""

    def __init__(self, lexicon: list[str], text: View, meta: View):
        self.lexicon, self.text, self.meta, self.prior, self.exchanged = lexicon, text, meta, 0.0, {}


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = 2, labelled: int = 20_000, lexicon: int = 256, exchange: int = 1_000, confident: float = 0.98) -> CoTrained:
    truth = accepted(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    truth = C.written(truth, "truth")
    small = F.broadcast(truth)  # at most `labelled` rows of two numbers
    words = learn_lexicon(C.written(docs.select("doc_id", "text").join(small, "doc_id").select("text", "y"), "labelled-texts"), lexicon)
    every = C.written(featured(docs, words), "features")
    known = C.written(every.join(small, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "doc_id"), 5)).coalesce(8), "labelled-features")
    fit, calibrate = known.where("fold > 0"), known.where("fold = 0")
    unlabelled = every.join(F.broadcast(truth.select("doc_id")), "doc_id", "left_anti")
    good, count = (lambda r: (r[0] or 0.0, r[1]))(known.agg(F.sum("y"), F.count(F.lit(1))).first())
    views = {"text_x": View("text_x"), "meta_x": View("meta_x")}
    model = CoTrained(words, views["text_x"], views["meta_x"])
    extra: dict[str, list[DataFrame]] = {"text_x": [], "meta_x": []}
    for turn in range(rounds + 1):
        for name, view in views.items():
            rows = fit.select("y", name)
            for more in extra[name]:
                rows = rows.unionByName(more.select("y", name))
            view.fit(C.written(rows.coalesce(8), "training") if turn else rows, calibrate)
        if turn == rounds:
            break
        for name, other in (("text_x", "meta_x"), ("meta_x", "text_x")):
            if views[name].weights is None:
                continue
            held = [tuple(r) for r in calibrate.select(views[name].odds(), "y").collect()]  # a fifth of at most `labelled` rows
            scored = unlabelled.select("doc_id", other, views[name].odds().alias("o"))
            # per class the most confident ones; what is passed on is bounded by the parameter, the search is not
            picked = [
                scored.where(F.col("o") >= cut if y else F.col("o") <= cut).orderBy(F.desc("o") if y else F.asc("o"), F.xxhash64("doc_id")).limit(exchange).select(F.lit(y).alias("y"), other)
                for y, cut in confident_cuts(held, confident).items()
            ]
            if picked:
                passed = C.written(picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1]), "pseudo-labels")
                extra[other].append(passed)
                of = dict(passed.groupBy("y").count().collect())  # two rows
                model.exchanged[turn, name] = (of.get(0.0, 0), of.get(1.0, 0))
    if all(view.weights is not None for view in views.values()):
        model.prior = log((good + 1) / (count - good + 1))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """docs with text_score, meta_score (calibrated probabilities of acceptance), score (both combined) and kept.

    Null and empty texts, and null metadata, are values with features of their own; repeated rows get equal scores;
    without labels of both classes every score is one half and, at the threshold of one half, all is kept; columns called
    like the new ones are replaced, others pass through; an empty table stays empty.
    """
    model = co_train(docs, labels, **training)
    return score_all(docs, model, threshold)


def score_all(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """docs with the scores of a trained model; see quality_scores()."""
    places = {w: i for i, w in enumerate(model.lexicon)}
    new = ["text_score", "meta_score", "score"]
    source = docs.drop(*new, "kept")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for batch in batches:
            text, lang, source_, chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
            a = model.text.log_odds(np.array([text_features(t, places) for t in text], np.float64).reshape(len(text), -1))
            b = model.meta.log_odds(np.array([meta_features(*m) for m in zip(lang, source_, chars)], np.float64).reshape(len(text), -1))
            scores = [sigmoid(a), sigmoid(b), sigmoid(a + b - model.prior)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], names=[*batch.schema.names, *new])

    schema = T.StructType([*source.schema, *(T.StructField(c, T.DoubleType()) for c in new)])
    return source.mapInArrow(run, schema).withColumn("kept", F.col("score") >= threshold)
