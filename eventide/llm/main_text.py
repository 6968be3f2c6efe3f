"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of tokens: tags score negative, words score by the element they stand in, positive where labelled
pages have main text.  One linear scan finds the contiguous run of tokens with the largest sum.  The weights come from
labelled pages: pages that mark their main text with one <article> or <main> element, of which a bounded sample is read.
Elements that HTML names as something else (menus, forms, scripts and the like) are left out within the run, and so are those
whose class, id and role speak against them more than their element speaks for them; the run is widened to the ends of the
blocks in which it starts and ends, and of every marked element that it holds words of.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

# Element names of HTML by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title", "head"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "label", "input", "option"} | RAW
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MARKED = {"article", "main"}
#: Words of class, id or role that weigh as boilerplate from the start; others learn their weight.
ROLES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo",
    "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

#: Bound of weights, and the weight of inline tags that no labelled page holds.
BOUND, UNSEEN = 3.0, -0.1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^<>\"']*")
_SKIPPED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_NAMING = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
#: Elements whose start ends an open one of the same kind.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: ("text", "", text), ("open", name, attributes) or ("close", name, "").

    One pass without going back: a tag that never ends, or in which another one starts, is text; a comment without an end
    reaches to the end of the page.  Quotes count only where a value starts.
    """
    at, n, ends = 0, len(html), {'"': True, "'": True}
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            yield "text", "", html[at:end]
            at = end
            continue
        after = html[at + 1 : at + 2]
        if after in ("!", "?") and after or after == "/" and not html[at + 2 : at + 3].isalpha():
            closing = next((c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(o, at)), ">")
            end = html.find(closing, at + 2)
            at = n if end < 0 else end + len(closing)
            continue
        named = _NAME.match(html, at + (2 if after == "/" else 1))
        if not named:
            yield "text", "", "<"
            at += 1
            continue
        k = named.end()
        while True:
            k = _PLAIN.match(html, k).end()
            mark = html[k : k + 1]
            if mark not in ends or not mark:
                break
            value = ends[mark] and html[max(0, k - 64) : k].rstrip().endswith("=")
            end = html.find(mark, k + 1) if value else k
            ends[mark] = ends[mark] and end >= 0  # if no such quote follows, none will
            k = max(end, k) + 1
        if mark != ">":
            yield "text", "", html[at:k]
        elif after == "/":
            yield "close", named[0].lower(), ""
        else:
            yield "open", named[0].lower(), html[named.end() : k]
        at = k + (mark == ">")
        if mark == ">" and after != "/" and (name := named[0].lower()) in _SKIPPED:
            end = _SKIPPED[name].search(html, at)
            at = end.end() if end else n


def parts_of(attributes: str) -> list[list[str]]:
    """The words of each name in class, id and role."""
    named = " ".join(x for m in _NAMING.findall(attributes) for x in m if x).lower()
    return [words for name in named.split() if (words := [w for w in _PARTS.split(name) if w])]


def speaks_against(element: str, names: list[list[str]], weights: dict[str, float]) -> bool:
    """Whether a name of an element, by the mean weight of its words, outweighs half of what the element itself weighs."""
    own = weights.get(element, 0.0) / 2
    return any((mean := sum(-BOUND if w in ROLES else min(0.0, weights.get("." + w, 0.0)) for w in words) / len(words)) < 0 and mean + own < 0 for words in names)


def tokens(html: str, weights: dict[str, float] | None = None, spans: list | None = None) -> list[tuple]:
    """(kind, name, words, text, skipped, marked) in page order; kind is "tag" or "text", name the tag, the same for both ends,
    or the innermost element around the text, skipped whether it lies in boilerplate, marked the number of the article or
    main element around it, 0 outside.  ``spans`` gets (names' words, first token, end) of each element with a name."""
    out, stack, open_names, skips, inside, marks, weights = [], [], Counter(), 0, [], 0, weights or {}

    def leave() -> str:
        nonlocal skips
        name, skip, mark, named, first = stack.pop()
        open_names[name] -= 1
        if named and spans is not None:
            spans.append(({w for words in named for w in words}, first, len(out)))
        skips -= skip
        if mark:
            inside.pop()
        return name

    for kind, name, rest in pieces(html):
        if kind == "text":
            out.append(("text", stack[-1][0] if stack else "", len(rest.split()), rest, skips > 0, inside[-1] if inside else 0))
        elif kind == "open":
            while stack and stack[-1][0] in _SELF_CLOSING.get(name, ()):
                leave()
            out.append(("tag", name, 0, "", skips > 0, inside[-1] if inside else 0))
            if name not in VOID and name not in _SKIPPED and not rest.endswith("/"):
                named = parts_of(rest) if rest and name not in ("body", "html") else []
                skip = name in BOILERPLATE or bool(named) and speaks_against(name, named, weights)
                skips += skip
                mark = name in MARKED and not skips
                if mark:
                    marks += 1
                    inside.append(marks)
                stack.append((name, skip, mark, named, len(out)))
                open_names[name] += 1
        else:
            if open_names[name]:
                while leave() != name:
                    pass
            out.append(("tag", name, 0, "", skips > 0, inside[-1] if inside else 0))
    while stack:
        leave()
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum, the first among equals and as long as it can be; (0, 0) if none
    is positive."""
    best, start, end, total, since = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, since = 0.0, i
        total += x
        if total > best or total == best > 0 and since == start:
            best, start, end = total, since, i + 1
    return start, end


def main_text(html: str | None, weights: dict[str, float]) -> str:
    found = tokens(html or "", weights)
    tag, word = weights["<tag>"], weights["<word>"]
    unseen = lambda name: tag if name in BLOCKS else UNSEEN
    scores = [weights.get("<" + t[1], unseen(t[1])) if t[0] == "tag" else t[2] * (-abs(word) if t[4] else weights.get(t[1], word)) for t in found]
    start, end = best_run(scores)
    # no block is cut
    inline = lambda t: t[0] == "text" or t[1] not in BLOCKS
    while 0 < start < end and inline(found[start]) and inline(found[start - 1]):
        start -= 1
    while 0 < end < len(found) and inline(found[end - 1]) and inline(found[end]):
        end += 1
    # the ends are widened to those of every marked element whose words the run holds; nothing of the run is dropped
    held = {t[5] for t in found[start:end] if t[5] and t[2] and not t[4]}
    places = [i for i, t in enumerate(found) if t[5] in held]
    chosen = found[min(start, places[0]) : max(end, places[-1] + 1)] if places else found[start:end]
    blocks, now = [], []
    for kind, name, _, text, skipped, _ in chosen:
        if kind == "text":
            if not skipped:
                now.append(text)
        elif name in BLOCKS:
            blocks.append(now)
            now = []
        elif name in ("br", "td", "th"):
            now.append(" ")
    blocks.append(now)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, html: str = "html", labelled: int = 5000, names: int = 300) -> dict[str, float]:
    """Weights from at most ``labelled`` pages that mark their main text, taken in order of a hash of page_id.

    A word's weight is the log ratio of how often words in its element stand in main text and outside, bounded to +-3; a
    tag's weight, one for both ends, is negative, the more so the rarer the tag is in main text; a name's weight tells how often
    text under a class, id or role with that word is main text.  Pages without a mark teach nothing; if there is none at all,
    words count 1 and tags -1.
    """
    marked = pages.where(F.lower(F.col(html)).rlike("<(article|main)[ >]"))
    chosen = marked.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(labelled)
    sample = marked.join(F.broadcast(chosen), "page_id").select(html)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, rest = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                spans, upto = [], [(0, 0)]
                found = tokens(page or "", None, spans)
                for _, _, words, _, _, mark in found:
                    upto.append((upto[-1][0] + words * bool(mark), upto[-1][1] + words * (not mark)))
                for named, first, end in spans:
                    for word in named:
                        main["." + word] += upto[end][0] - upto[first][0]
                        rest["." + word] += upto[end][1] - upto[first][1]
                for kind, name, words, _, skipped, mark in found:
                    if kind == "text" and skipped:
                        continue  # never main text, whatever the weight of its element
                    side = main if mark and not skipped else rest
                    side["<" + name if kind == "tag" else name] += 1 if kind == "tag" else words
        keys = sorted({*main, *rest})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([main[k] for k in keys], pa.int64()), pa.array([rest[k] for k in keys], pa.int64())], names=["name", "main", "rest"])

    counts = sample.mapInArrow(count, "name string, main long, rest long").groupBy("name").agg(F.sum("main").alias("main"), F.sum("rest").alias("rest"))
    often = Window.partitionBy(F.col("name").startswith(".")).orderBy(F.desc(F.col("main") + F.col("rest")), "name")
    top = counts.withColumn("place", F.row_number().over(often)).where(F.col("place") <= names).select("name", "main", "rest").collect()  # at most twice `names` rows
    weights = {"<tag>": -1.0, "<word>": 1.0}
    for name, main, rest in top:
        share = (main + 1) / (main + rest + 2)
        ratio = max(-BOUND, min(BOUND, _log_odds(share)))
        weights[name] = min(-0.1, ratio) if name.startswith("<") else ratio
    return weights


def _log_odds(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def extract_main_text(pages: DataFrame, html: str = "html", labelled: int = 5000) -> DataFrame:
    """pages with text (empty if there is none) and n_chars, its code points, in place of the html.

    Null and empty pages have no text; a page of any length is read whole; runs that tie go to the first; repeated rows
    and extra columns pass through, and columns called text or n_chars are replaced; an empty table stays empty.
    """
    weights = learn(pages, html, labelled)
    source = pages.drop("text", "n_chars")
    kept = [f for f in source.schema if f.name != html]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(html).to_pylist()]
            columns = [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "text", "n_chars"])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
