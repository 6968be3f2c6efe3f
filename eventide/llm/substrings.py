"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

A suffix array would sort every byte position by what follows it.  Here bucket-pointer refinement works on a sparse set
of suffixes that loses nothing:

* Of the q-grams in each window of ``length`` bytes the one of the smallest hash is its anchor.  Equal windows have their
  anchor at the same place, so only anchors, about one in 190 bytes, need to be sorted into buckets.  An anchor stands
  for a run of neighbouring windows; a window is known by the offset of its anchor.
* The initial bucket of an anchor is its q-gram.  A bucket with one member is done: none of its windows is repeated.
* Refinement: offsets are cut into blocks, and a block's bucket is the string that all its windows share (its core).  Its
  identifier comes from the bucket before, which covers the middle of that string, and the identifiers of the strings at
  the offsets to both sides that the new bucket adds.  The update is used again by the next step: buckets grow
  from the q-gram to the cores of large blocks, then of small ones, then to single windows.
* A core that no other anchor shares ends a block; two equal spans (all bytes that any window of the block holds) settle it,
  since then all its windows are repeated; what is neither is refined further.  Only members whose bucket holds different
  spans go on, one member standing for all with equal spans.

A step groups by bucket identifier, with partial aggregation, where a sort in memory would order a bucket: no bucket is
collected.  Identifiers are 64-bit fingerprints of the strings, not ranks, so none has to be looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

GRAM = 32
#: Bytes of a text that are worked on at once.
CHUNK = 1 << 22
_P = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 17)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes along the last axis."""
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(data.shape[-1])[0][: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def _hash(first: np.ndarray, last: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Of the bytes between two prefix hashes, the first of which is at ``start``."""
    with np.errstate(over="ignore"):
        return _mix((last - first) * _power(int(start.max(initial=0)))[1][start] + np.asarray(size, np.uint64) * np.uint64(_P))


def anchors(data: bytes, length: int) -> np.ndarray:
    """Rows (anchor, first window, last window, q-gram hash, span hash) as int64, in order; a window is its start."""
    pieces, n = [], len(data)
    for low in range(0, max(0, n - length + 1), CHUNK):
        high = min(low + CHUNK, n - length + 1)
        base = max(0, low - length)
        part = np.frombuffer(data, np.uint8, min(n, high + 2 * length) - base, base)
        prefix = _prefix(part)
        at = np.arange(low - base, high - base + length - GRAM)
        grams = _hash(prefix[at], prefix[at + GRAM], at, GRAM)
        width, mask = length - GRAM + 1, np.uint64((1 << 24) - 1)
        keyed = np.full(-(-len(at) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        keyed[: len(at)] = (grams & ~mask) | np.arange(len(at), dtype=np.uint64)
        rows = keyed.reshape(-1, width)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        window = np.arange(high - low)
        anchor = (np.minimum(right[window], left[window + width - 1]) & mask).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        anchor = anchor[first]
        gram = grams[anchor]
        a = anchor + low - base  # place in part
        start, end = np.maximum(0, a - (length - GRAM)), np.minimum(len(part), a + length)
        span = _mix(_hash(prefix[start], prefix[end], start, end - start) + _shape(a - start, end - a))
        pieces.append(np.stack([a + base, first + low, last + low, gram.view(np.int64), span.view(np.int64)], axis=1))
    if not pieces:
        return np.zeros((0, 5), np.int64)
    out = np.concatenate(pieces)
    joined = np.flatnonzero(out[1:, 0] == out[:-1, 0])  # a run that crosses chunks is one run
    out[joined, 2] = out[joined + 1, 2]
    return np.delete(out, joined + 1, axis=0)


def _shape(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far a span reaches to both sides of its anchor: less than a block asks for at the ends of a text."""
    return (left * 65536 + right).astype(np.uint64)


def _blocks(batch: pa.RecordBatch, length: int, step: int, before: int | None) -> pa.RecordBatch:
    """Each segment's blocks of ``step`` offsets, with their bucket (core) and span hash; only offsets from lo to hi are of
    interest.  They lie in one block of ``before`` offsets, whose bucket the segment brings; None: the bucket is the q-gram."""
    segments = batch.column("segment").to_pylist()
    lo, hi, left = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi", "left"))
    sizes = np.array([len(s) for s in segments], np.int64)
    data = np.zeros((len(segments), 2 * length - GRAM), np.uint8)
    for i, s in enumerate(segments):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
    prefix = _prefix(data)
    counts = hi // step - lo // step + 1
    row = np.repeat(np.arange(len(segments)), counts)
    block = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + (lo // step)[row]
    o0, o1 = block * step, np.minimum(block * step + step - 1, length - GRAM)
    a = left[row]
    # the bucket before covers known bytes: from so many before the anchor to so many behind it
    known = (lo // before * before)[row] if before else np.zeros(len(row), np.int64)
    reach = length - np.minimum(known + before - 1, length - GRAM) if before else np.full(len(row), GRAM)
    earlier = _hash(prefix[row, a - o0], prefix[row, a - known], a - o0, o0 - known)
    later = _hash(prefix[row, a + reach], prefix[row, a - o1 + length], a + reach, length - o1 - reach)
    bucket = batch.column("bucket").to_numpy(zero_copy_only=False).view(np.uint64)[row]
    with np.errstate(over="ignore"):
        core = _mix(_mix(bucket + earlier) * np.uint64(_P) + later + (block * 1024 + step).astype(np.uint64))
    start, end = np.maximum(0, a - o1), np.minimum(sizes[row], a - o0 + length)
    span = _mix(_hash(prefix[row, start], prefix[row, end], start, end - start) + _shape(a - start, end - a))
    take = pa.array(row)
    columns = {c: batch.column(c).take(take) for c in ("ka", "kb", "a", "open")}
    columns |= {"lo": pa.array(np.maximum(o0, lo[row]), pa.int32()), "hi": pa.array(np.minimum(o1, hi[row]), pa.int32()), "core": pa.array(core.view(np.int64)), "span": pa.array(span.view(np.int64))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def anchored(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(ka, kb, a, first, last, gram, span) of every text of ``length`` bytes or more: its key and arrays of its anchors,
    written once and read by each step that needs them."""
    data = C.whole(text).cast("binary")
    keyed = docs.select(C.text_key(C.whole(text)).alias("k"), data.alias("data")).where(F.octet_length("data") >= length).select(F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "data")

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(x.as_py(), length) for x in batch.column("data")]
            rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(rows[:, i].astype(np.int32 if i < 3 else np.int64))) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), *lists], names=["ka", "kb", "a", "first", "last", "gram", "span"])

    return C.written(keyed.mapInArrow(emit, "ka long, kb long, a array<int>, first array<int>, last array<int>, gram array<long>, span array<long>"), "anchors")


def repeated(docs: DataFrame, rows: DataFrame, text: str, length: int, steps: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(single, found): anchors whose run is not repeated as a whole, by text key; and the repeated windows within such
    runs, as (ka, kb, first, last).  ``rows`` is anchored() of docs."""
    keyed = docs.select("doc_id", C.text_key(C.whole(text)).alias("k"), C.whole(text).cast("binary").alias("data")).select("doc_id", "k.*", "data").withColumnsRenamed({"a": "ka", "b": "kb"})
    member = F.struct("ka", "kb", "a", "first", "last")
    each = rows.select("ka", "kb", F.inline(F.arrays_zip("a", "first", "last", "gram", "span")))
    classes = C.written(each.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("m")), "anchor-classes")
    # a member alone in its class is single; where its bucket holds other classes, all of them are refined
    mixed = C.written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("classes > 1 AND least = 1").select("gram", "classes", F.lit(True).alias("refine")), "mixed-buckets")
    told = C.spread_join(classes, mixed, ["gram"], "classes", "left").where("n = 1 OR refine")
    told = C.written(told.select("m.*", "gram", (F.col("n") == 1).alias("open"), F.coalesce("refine", F.lit(False)).alias("refine")), "told-anchors")
    C.drop(classes, mixed)

    # one document of each text brings the bytes around the anchors to refine
    asked = told.where("refine").groupBy("ka", "kb").agg(F.collect_list(F.struct("a", "first", "last", "open", "gram")).alias("nodes"))
    holder = keyed.groupBy("ka", "kb").agg(F.min("doc_id").alias("holder"))
    asked = asked.join(holder, ["ka", "kb"])
    texts = keyed.alias("d").join(asked.alias("n"), (F.col("d.ka") == F.col("n.ka")) & (F.col("d.kb") == F.col("n.kb")) & F.col("d.doc_id").eqNullSafe(F.col("n.holder"))).select("d.ka", "d.kb", "d.data", "n.nodes")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "a", "lo", "hi", "left", "open", "bucket", "segment")}
            for i, (data, nodes) in enumerate(zip(batch.column("data").to_pylist(), batch.column("nodes").to_pylist())):
                for node in nodes:
                    a, start = node["a"], max(0, node["a"] - (length - GRAM))
                    for c, v in zip(out, (i, a, a - node["last"], a - node["first"], a - start, node["open"], node["gram"], data[start : a + length])):
                        out[c].append(v)
            take = pa.array(out.pop("row"), pa.int64())
            kinds = [pa.int32()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("ka").take(take), batch.column("kb").take(take), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["ka", "kb", *out])

    segments = C.written(texts.mapInArrow(cut, "ka long, kb long, a int, lo int, hi int, left int, open boolean, bucket long, segment binary"), "segments")
    found, nodes, read = [], segments, []
    for turn, step in enumerate(steps):
        blocks = nodes.mapInArrow(lambda it, step=step, before=steps[turn - 1] if turn else None: (_blocks(b, length, step, before) for b in it if b.num_rows), "ka long, kb long, a int, open boolean, lo int, hi int, core long, span long")
        blocks = C.written(blocks, "blocks")
        C.drop(*read, *([segments] if turn + 1 == len(steps) else []))
        classes = C.written(blocks.groupBy("core", "span").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open"), F.min(F.struct("ka", "kb", "a", "lo", "hi", "open")).alias("m")), "classes")
        shared = classes.where("n > 1 AND any_open").select("core", "span", "n")
        settled = C.spread_join(blocks.where("open"), shared, ["core", "span"], "n", "left_semi").select("ka", "kb", (F.col("a") - F.col("hi")).alias("first"), (F.col("a") - F.col("lo")).alias("last"))
        found.append(C.written(settled, "windows"))
        C.drop(blocks)
        if turn + 1 < len(steps):
            mixed = C.written(classes.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("any_open") & (F.col("n") == 1)).alias("some")).where("c > 1 AND some").select("core", "c"), "mixed-cores")
            onward = C.spread_join(classes, mixed, ["core"], "c", "left_semi").select("m.ka", "m.kb", "m.a", "m.lo", "m.hi", F.col("core").alias("bucket"), (F.col("m.open") & (F.col("n") == 1)).alias("open"))
            nodes = onward.join(segments.select("ka", "kb", "a", "left", "segment"), ["ka", "kb", "a"])
            read = [classes, mixed]
    C.drop(classes)
    return told.where("open").select("ka", "kb", "a"), reduce(DataFrame.unionByName, found)


def removed_spans(docs: DataFrame, text: str, length: int, steps: tuple[int, ...]) -> DataFrame:
    """(ka, kb, spans) of every text that loses bytes: its key, and the starts and ends of what it loses in turn; written."""
    rows = anchored(docs, text, length)
    single, found = repeated(docs, rows, text, length, steps)
    lists = single.groupBy("ka", "kb").agg(F.collect_set("a").alias("single")).join(found.groupBy("ka", "kb").agg(F.collect_set(F.struct("first", "last")).alias("found")), ["ka", "kb"], "left")
    runs = rows.select("ka", "kb", "a", "first", "last").join(lists, ["ka", "kb"], "left")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for a, first, last, single_, found_ in zip(*(batch.column(c) for c in ("a", "first", "last", "single", "found"))):
                whole = ~np.isin(a.values.to_numpy(), single_.values.to_numpy()) if single_.is_valid else np.ones(len(a), bool)
                parts = found_.values.flatten() if found_.is_valid else [pa.array([], pa.int32())] * 2
                start, end = np.r_[first.values.to_numpy()[whole], parts[0].to_numpy()], np.r_[last.values.to_numpy()[whole], parts[1].to_numpy()] + length
                order = np.argsort(start, kind="stable")
                out.append(_union(start[order], np.maximum.accumulate(end[order])) if len(order) else np.zeros((0, 2), np.int32))
            ends = pa.array(np.cumsum([0, *(2 * len(x) for x in out)]), pa.int32())
            spans = pa.array(np.concatenate([x.ravel() for x in out]).astype(np.int32) if out else [], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb"), pa.ListArray.from_arrays(ends, spans)], names=["ka", "kb", "spans"])

    # equal texts have equal spans, so one row of each stands for all
    return C.written(runs.mapInArrow(merge, "ka long, kb long, spans array<int>").where(F.size("spans") > 0).dropDuplicates(["ka", "kb"]), "removed-spans")


def substring_dedup(docs: DataFrame, text: str = "text", length: int = 400, steps: tuple[int, ...] = (24, 1), keep_bytes: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` the remaining bytes as kept.

    Texts are taken as UTF-8, matches do not cross rows, and whether a string repeats is judged on the input alone.  Null
    and empty texts, and texts shorter than ``length``, keep everything; rows with equal texts of ``length`` bytes or more
    lose everything, whatever their doc_id; extra columns pass through, and those called like the new ones are replaced;
    an empty table stays empty.  ``steps`` are the sizes of blocks; each divides the one before, and the last is 1.
    """
    if steps[-1] != 1 or any(a % b for a, b in zip(steps, steps[1:])):
        raise ValueError("each step has to divide the one before, and the last has to be 1")
    spark = docs.sparkSession
    with C.shuffles_freed(spark), C.cleaned(spark) as stays:
        gone = removed_spans(docs.select("doc_id", text), text, length, steps)
        stays.add(gone.written_to)
    new = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()} | ({"kept": T.BinaryType()} if keep_bytes else {})
    source = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    keyed = source.withColumn("__k", C.text_key(C.whole(text)))
    joined = keyed.join(gone.select(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("__k"), F.col("spans").alias("__spans")), "__k", "left").drop("__k")
    kept = [c for c in source.columns if keep_bytes or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in new}
            for t, s in zip(batch.column(text), batch.column("__spans")):
                data, spans = (t.as_py() or "").encode(), s.as_py() or []
                edges = [0, *spans, len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else data
                for c, v in zip(new, (len(data), len(data) - len(left), len(spans) // 2, hashlib.sha256(left).hexdigest(), left)):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, {"kept_sha256": pa.string(), "kept": pa.binary()}.get(c, pa.int64())) for c, v in rows.items())], names=[*kept, *new])

    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(c, k) for c, k in new.items())])
    return joined.mapInArrow(run, schema)


def _union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of the intervals, as rows of neighbours joined; starts are in order, ends the largest so far."""
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return np.stack([start[first], end[np.r_[first[1:] - 1, len(end) - 1]]], axis=1)
