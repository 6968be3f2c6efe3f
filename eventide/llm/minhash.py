"""MinHash near-dedup with fast similarity sketches, banding, and exact verification.

Sketch.  A set is thrown at ``size`` bins in rounds.  In round i < size every element falls, by a hash of its own and of
i, into one bin with a value i + fraction, and each bin keeps its minimum; in later rounds every element falls into bin
i - size, so after at most 2 * size rounds each bin is filled.  Rounds end once no bin is empty: large sets need one or
two.  Two sets agree in a bin with the probability of their Jaccard similarity, and the share of agreeing bins is
concentrated around it at least as tightly as with independent MinHashes.

Groups.  Rows with equal shingle sets form a class and are represented by one row.  Bands of the sketch put classes into
buckets.  In the first rounds every member of a bucket is held against one centre of it, another one each round, so a
bucket of near copies costs a comparison per member, not per pair; whoever is linked joins the centre's component.  Then
what is still open is compared to the end: every two members of different components of a bucket, by a join where these
are few, in blocks of members (without a row per pair) where they are many.  A pair of the joins is looked at in full
only if its parity sketches, a bit per coordinate, differ in few bits; the bound lies eight deviations beyond what a pair
at the similarity has.  Links are confirmed on full sets, and no link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_A = np.uint64(0x9E3779B97F4A7C15)
_WORD_CACHE = 1_000_000
#: Buckets with more open pairs than this are compared in blocks of so many members.
DENSE, CHUNK = 2_000, 500


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    empty = np.iinfo(np.uint64).max
    bins = np.full(size, empty, np.uint64)
    low = np.uint64((1 << 52) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            h = _mix(elements + np.uint64(i + 1) * _A)
            value = (np.uint64(i) << np.uint64(52)) | (h & low)
            if i < size:
                np.minimum.at(bins, (h >> np.uint64(52)) % np.uint64(size), value)
            else:
                bins[i - size] = min(bins[i - size], value.min())
            # further rounds change nothing once every bin is filled, so it need not be looked at after each of them
            if (i % 4 == 3 or len(elements) >= size) and not (bins == empty).any():
                break
    return bins


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's runs of ``width`` words; of all words where there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), width)):
            x = _mix(x * _A + h[k : k + n])
    return np.unique(x)


def _signatures(batches: Iterable[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """text -> node (digest of the shingle set), n, and the hash of each band, numbered."""
    import xxhash

    hashes = _WordHashes()
    weights = (np.arange(1, rows + 1, dtype=np.uint64) * _A) | np.uint64(1)
    words = -(-bands * rows // 64)
    for batch in batches:
        nodes, sizes, bucket, parity = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, width, hashes)
            sizes.append(len(found))
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
            if len(found):
                with np.errstate(over="ignore"):
                    coordinates = _mix(sketch(found, bands * rows))
                    bits = np.zeros(64 * words, np.uint8)
                    bits[: bands * rows] = coordinates & np.uint64(1)
                    parity.append(np.packbits(bits).view(np.int64))
                    mixed = (coordinates.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64)
                    bucket.append(_mix(mixed + np.arange(bands, dtype=np.uint64) * weights[0]).view(np.int64))
            else:
                parity.append(np.zeros(words, np.int64))
                bucket.append(np.zeros(0, np.int64))
        keep = [batch.column(c) for c in ("doc_id", "key")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(bucket, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "n", "parity", "buckets"])


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        found = [shingles(t, width, hashes).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the undirected edges (u, v) reaches.

    Alternating stars: every node's larger neighbours, then its smaller ones, are hung on the smallest.  A round is two
    groupings and two joins, whatever the size of a star, and the number of rounds grows with the logarithm of the longest
    path.
    """
    pairs = C.written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, pairs = pairs, C.written(small, "edges")
        C.remove(edges.sparkSession, before.written_to)
        # done once every node hangs on one other, which hangs on none
        centres = pairs.select(F.col("v").alias("u"), F.lit(1).alias("centre")).distinct()
        loose = pairs.join(centres, "u", "left").groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.max("centre").alias("centre")).where("c > 1 OR centre = 1")
        if loose.isEmpty():
            # a component's own centre is not among its nodes; callers take a node without a row as its own component
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    shared = pairs.join(left, "u").join(right, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return shared.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("u", "v")


def _comparable(percent: int, bits: int, a: str, b: str):
    """Whether sets of these sizes and parity sketches can reach the similarity; columns are n and parity, n_b and parity_b."""
    j = percent / 100
    # bits differ with probability (1 - j) / 2
    most = bits * (1 - j) / 2 + 8 * (bits * (1 - j) * (1 + j) / 4) ** 0.5
    differing = F.aggregate(F.zip_with(f"parity{a}", f"parity{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 * F.least(f"n{a}", f"n{b}") >= percent * F.greatest(f"n{a}", f"n{b}")) & (differing <= most)


def _dense(members: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components in buckets with many open pairs, found in blocks without a row per pair.

    Members are cut into chunks; each pair of a chunk of minor members (outside the bucket's largest component) and a
    chunk of all members is one group, which holds at most two chunks of sets whatever the bucket's size.  A pair is
    looked at in the first band that it shares.
    """
    chunks = F.ceil(F.col("all") / CHUNK)
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    others = F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))
    side = lambda rows, i, j, left: rows.select("bucket", "node", "component", i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    cut = members.withColumn("own", own).withColumn("other", others)
    blocks = side(cut.where("component <> largest"), F.col("own"), F.col("other"), True).unionByName(side(cut, F.col("other"), F.col("own"), False))
    bands = signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("buckets").alias("buckets"))
    rows = blocks.join(sets.join(bands, "node"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        found: list[tuple[bytes, bytes]] = []
        if len(left) and len(right):
            bucket = group["bucket"].iloc[0]
            sizes = right["shingles"].map(len).to_numpy()
            values = np.concatenate(right["shingles"].to_list())
            order = np.argsort(values, kind="stable")
            values, owners = values[order], np.repeat(np.arange(len(right)), sizes)[order]
            right_bands, right_component, right_node = np.stack(right["buckets"].to_list()), right["component"].to_numpy(), right["node"].to_list()
            for node, component, mine, my_bands in zip(left["node"], left["component"], left["shingles"], left["buckets"]):
                shared = right_bands == my_bands
                here = right_bands[np.arange(len(right)), shared.argmax(axis=1)] == bucket
                lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                width = hi - lo
                places = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
                common = np.bincount(owners[places], minlength=len(right))
                hit = here & (right_component != component) & (100 * common >= percent * (len(mine) + sizes - common))
                found += [(min(node, right_node[k]), max(node, right_node[k])) for k in np.flatnonzero(hit)]
        return pd.DataFrame(found, columns=["u", "v"])

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "u binary, v binary").distinct()


def near_links(docs: DataFrame, text: str = "text", width: int = 4, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(signatures, links): node and n of each row of docs; node and component of every node that is linked."""
    source = docs.select("doc_id", C.text_key(C.whole(text)).alias("key"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = C.written(source.mapInArrow(lambda it: _signatures(it, width, bands, rows), f"doc_id {id_type}, key struct<a:long,b:long>, node binary, n long, parity array<long>, buckets array<long>"), "signatures")
    # buckets with one class propose nothing
    dealt = signed.select("node", "n", "parity", F.explode("buckets").alias("bucket")).distinct()
    crowded = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    members = C.written(dealt.join(crowded, "bucket"), "members")
    # one row of docs stands for each class that some bucket holds with another
    wanted = signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("r")).select("node", F.col("r.doc_id").alias("r_id"), F.col("r.key").alias("r_key"))
    texts = source.join(wanted, source.doc_id.eqNullSafe(wanted.r_id) & (source.key == wanted.r_key)).select("node", "text")
    sets = C.written(texts.mapInArrow(lambda it: _sets(it, width), "node binary, shingles array<long>"), "sets")
    if sets.count() > sets.select("node").distinct().count():  # rows that are repeated as a whole
        sets = C.written(sets.dropDuplicates(["node"]), "sets")

    links, state = None, None
    for turn in range(rounds + 1):
        if state is None:
            open_members = members.withColumn("component", F.col("node"))
        else:
            open_members = members.join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = open_members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
            open_members = C.written(open_members.join(mixed, "bucket"), "open-members")
        if turn < rounds:
            # one centre a bucket, another one each turn; everything of another component is held against it
            chosen = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("parity").alias("parity_v"), F.col("component").alias("c_v"))
            centres = open_members.groupBy("bucket").agg(F.min(chosen).alias("c")).select("bucket", "c.*")
            pairs = open_members.join(centres, "bucket").where((F.col("component") != F.col("c_v")) & _comparable(percent, bands * rows, "", "_v"))
            if turn == 0:  # in all of a node's buckets, the first of their centres
                pairs = pairs.groupBy(F.col("node").alias("u")).agg(F.min(F.struct("o", "v")).alias("c")).select("u", "c.v")
            pairs = pairs.select(F.col("node").alias("u"), "v") if turn else pairs
        else:
            # what is left: every two of different components, all of a bucket against those outside its largest component
            counts = open_members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
            largest = counts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all")).select("bucket", F.col("m.component").alias("largest"), "all", ((F.col("all") - F.col("m.c")) * F.col("all") > DENSE).alias("dense"))
            placed = C.written(open_members.join(largest, "bucket"), "placed-members")
            dense_links = C.written(_dense(placed.where("dense"), signed, sets, percent), "links")
            sparse = placed.where("NOT dense")
            minor = sparse.where("component <> largest").select("bucket", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("parity").alias("parity_v"), F.col("component").alias("c_v"))
            pairs = sparse.join(minor, "bucket").where((F.col("component") != F.col("c_v")) & _comparable(percent, bands * rows, "", "_v")).select(F.col("node").alias("u"), "v")
        pairs = C.written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        found = C.written(_confirmed(pairs, sets, percent), "links")
        if turn == rounds:
            found = C.written(found.unionByName(dense_links).distinct(), "links")
        if links is None or not found.isEmpty():
            links = found if links is None else C.written(links.unionByName(found).distinct(), "links")
            state = components(links)
    return signed.select("doc_id", "key", "node", "n"), state


def near_dedup(docs: DataFrame, text: str = "text", width: int = 4, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 2) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of each row.

    component_id is the smallest doc_id that links reach, kept is doc_id = component_id.  A text without words has no
    shingles, is linked with nothing and is kept; null is such a text.  Rows with the same doc_id and text are one
    document and get the same row each.  Null ids are no one's component_id unless the whole component has none; kept
    compares them as equal.  Empty tables stay empty, other columns are ignored.
    """
    signed, state = near_links(docs, text, width, percent, bands, rows, rounds)
    placed = signed.join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = placed.join(smallest, "component", "left")
    component = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
