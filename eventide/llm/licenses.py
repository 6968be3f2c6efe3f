"""License scan by diagonal voting.

Every rolling k-gram of words of a document is joined to the places of the templates' k-grams.  A hit at document place p
and template place t votes for the diagonal p - t: a copy of the template puts all its votes on one diagonal, an edited
copy (a word more or less) on neighbouring ones.  Votes are summed by diagonal, neighbouring diagonals are merged into a
span, and a span is verified by the share of the template's words that its hits cover.  A licence whose sentences were
moved, or between which other text was put, falls into spans on distant diagonals: spans near each other are chained, and
a chain is verified by what its spans cover together.  DataFrame functions only.

Words are compared by 64-bit hash of k of them; the templates are constants, so their k-grams are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

# Phrases that are searched for as they stand, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Label and words of the public licence texts and notices that diagonal voting looks for.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]


def _template_grams(spark: SparkSession, gram: int) -> DataFrame:
    """(tid, label, t_words, at, h): every k-gram of every template."""
    rows = [(i, label, words.split()) for i, (label, words) in enumerate(TEMPLATES)]
    words = spark.createDataFrame(rows, "tid int, label string, w array<string>")
    return words.select("tid", "label", F.size("w").alias("t_words"), F.posexplode(_grams(F.col("w"), gram)).alias("at", "h"))


def _grams(words: Column, gram: int) -> Column:
    """Hash of the k words from each place on."""
    return F.when(F.size(words) >= gram, F.transform(F.sequence(F.lit(1), F.size(words) - gram + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(gram)))))


def license_spans(docs: DataFrame, text: str = "text", gram: int = 3, drift: int = 2, least: float = 0.8) -> DataFrame:
    """(doc_id, key, tid, label, t_words, span, first_at, last_at, votes, covered, score, verified): a row per merged run of
    diagonals.

    Diagonals not more than ``drift`` apart are merged; covered holds the places of the template's words that hits cover,
    score is their share, and a span is verified from ``least`` on.
    """
    worded = docs.select("doc_id", C.text_key(C.whole(text)).alias("key"), F.explode(F.array(C.alnum_words(C.ascii_lower(C.whole(text))))).alias("w"))
    grams = worded.select("doc_id", "key", F.posexplode(_grams(F.col("w"), gram)).alias("p", "h"))
    hits = grams.join(F.broadcast(_template_grams(docs.sparkSession, gram)), "h")
    votes = hits.groupBy("doc_id", "key", "tid", "label", "t_words", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.countDistinct("at").alias("votes"), F.min("p").alias("first_at"), F.max("p").alias("last_at"), F.collect_set("at").alias("ats")
    )
    along = Window.partitionBy("doc_id", "key", "tid").orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int")
    spans = (
        votes.withColumn("start", F.coalesce(starts, F.lit(0)))
        .withColumn("span", F.sum("start").over(along))
        .groupBy("doc_id", "key", "tid", "label", "t_words", "span")
        .agg(F.min("first_at").alias("first_at"), (F.max("last_at") + gram - 1).alias("last_at"), F.sum("votes").alias("votes"), F.flatten(F.collect_list("ats")).alias("ats"))
    )
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + gram - 1))))
    score = F.size("covered") / F.col("t_words")
    return spans.withColumn("covered", covered).select("doc_id", "key", "tid", "label", "t_words", "span", "first_at", "last_at", "votes", "covered", score.alias("score"), (score >= least).alias("verified"))


def license_chains(spans: DataFrame, block: int = 10, least: float = 0.8) -> DataFrame:
    """(doc_id, key, tid, label, first_at, last_at, score, verified): a row per chain of spans of one template.

    A span that starts within the template's length of the end of those before it joins their chain.  Score is the share of
    the template's words that the chain's spans of ``block`` words or more cover together, in whatever order, or that its
    best span covers; shorter spans are phrases that any text may hold, and count by themselves alone.
    """
    long = F.size("covered") >= block
    along = Window.partitionBy("doc_id", "key", "tid").orderBy("first_at", "span")
    reached = F.max(F.when(long, F.col("last_at"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(long & (F.col("first_at") - reached > F.col("t_words")), 1).otherwise(0)
    chains = (
        spans.withColumn("start", starts)
        .withColumn("chain", F.sum("start").over(along))
        .groupBy("doc_id", "key", "tid", "label", "t_words", "chain")
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("score").alias("best"), F.flatten(F.collect_list(F.when(long, F.col("covered")))).alias("covered"))
    )
    score = F.greatest("best", F.size(F.array_distinct("covered")) / F.col("t_words"))
    return chains.select("doc_id", "key", "tid", "label", "first_at", "last_at", score.alias("score"), (score >= least).alias("verified"))


def _places(words: Column, phrase: list[str]) -> Column:
    """The places from 0 at which the phrase's words stand one after another."""
    here = lambda i: F.array(*(F.get(words, i + k) for k in range(len(phrase)))) == F.array(*map(F.lit, phrase))
    return F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull() & here(i))


def license_scan(docs: DataFrame, text: str = "text", gram: int = 3, drift: int = 2, least: float = 0.8, block: int = 10) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts every place of a base phrase, first_word and last_word are the smallest and largest of those (null
    without any), labels adds those of verified chains, score is the best share of a template found (1 for a base phrase).
    Null and empty texts have no words and no labels; repeated rows get equal results; a null doc_id is a value like
    another; extra columns pass through, and those called like the new ones are replaced; an empty table stays empty.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    chains = license_chains(license_spans(docs, text, gram, drift, least), block, least)
    best = chains.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.max("score").alias("best"), F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("found"))
    best = C.written(best, "license-spans")
    kept = [c for c in docs.columns if c not in new]
    lowered = C.ascii_lower(C.whole(text))
    # a text without a phrase's first word as a substring has no place of it, and is not split at all
    some = F.lit(False)
    for phrase in PHRASES:
        some = some | F.contains(lowered, F.lit(phrase.split()[0])) & F.contains(lowered, F.lit(phrase.split()[-1]))
    words = F.when(some, C.alnum_words(lowered)).otherwise(F.array().cast("array<string>"))
    places = C.let(words, lambda w: F.struct(*(_places(w, p.split()).alias(f"p{i}") for i, p in enumerate(PHRASES))))
    based = docs.select(*kept, C.text_key(C.whole(text)).alias("__key"), C.n_parts(C.whole(text), C.NOT_ALNUM).alias("n_words"), F.explode(F.array(places)).alias("__p"))
    lists = [F.col(f"d.__p.p{i}") for i in range(len(PHRASES))]
    joined = based.alias("d").join(best.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.__id")) & (F.col("d.__key") == F.col("s.__key")), "left")
    every = F.concat(*lists)
    base_labels = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(lists, PHRASES.values()))))
    return joined.select(
        *(F.col(f"d.{c}").alias(c) for c in [*kept, "n_words"]),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("s.found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("s.best", F.lit(0.0)), F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
