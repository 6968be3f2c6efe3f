"""Hard negatives by exact inner-product search over shared lists of anchor clusters.

1. Anchors are clustered by direction.  The centres are fitted on a bounded sample of anchors; every anchor then joins its
   nearest centre, and a cluster's opening is the widest angle between its centre and a member.
2. Rows are scanned where they lie, in lists of bounded size.  For a cluster, a list is sorted once by the largest inner
   product that a row could have with any direction of the cluster: its length times the cosine of its angle to the centre,
   less the opening.  The sorted list serves every member: it is walked chunk by chunk until no row behind can matter to a
   member, which the bound of the next row certifies.
3. The best of each list are merged per anchor.  The first search finds an anchor's positives, the second, for each of
   them, the best rows of other labels within the band below its score.

Anchors are the stated query set; they are read from the shared folder in blocks, a cluster's block at a time, so neither a
task nor the driver holds them all.  Which centres there are changes how soon walks end, never what they find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Anchors that the centres are fitted on, centres at most, anchors of a block, numbers of a list (rows times dimensions), rows
#: of a list, and rows of a walk's first and longest chunk.
FIT_ROWS, CENTRES, BLOCK, LIST_NUMBERS, LIST_ROWS, CHUNK, LONGEST = 4096, 64, 1024, 1 << 22, 1 << 16, 256, 4096
#: Allowance for rounding: angles are widened by it, so that a bound is never below a score.
ANGLE, RELATIVE = 1e-6, 1e-9
NOTHING = np.iinfo(np.int64).min


def usable(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Rows with a label and a vector of finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)


def quantised(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


# ---- geometry


def fit_centres(sample: np.ndarray) -> np.ndarray:
    """Unit vectors: as many as the root of the sample's size, by a few rounds of means of directions."""
    length = np.linalg.norm(sample, axis=1)
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    n = min(CENTRES, int(np.ceil(np.sqrt(len(unit)))))
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(8):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def cosines(rows: np.ndarray, length: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row and centre; a row of zeros counts as lying on every centre."""
    return np.where(length[:, None] > 0, np.clip(rows @ centres.T / np.maximum(length, 1e-300)[:, None], -1, 1), 1.0)


def bounds(angle: np.ndarray, length: np.ndarray, opening: float) -> np.ndarray:
    """The most that a row's inner product with a unit vector of the cluster can be."""
    apart = np.maximum(angle - opening - ANGLE, 0)
    reach = length * np.cos(apart)
    return reach + np.abs(reach) * RELATIVE


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64, which hold integers below 2^53 exactly; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(flat) else np.zeros(0, int)] = flat
    return out


# ---- the walk


class Best:
    """The k best (score, place) of each of m x g groups: higher scores first, then lower places."""

    def __init__(self, m: int, g: int, k: int):
        self.g, self.k = g, k
        self.score, self.place = np.full((m * g, k), NOTHING), np.zeros((m * g, k), np.int64)

    def last(self) -> np.ndarray:
        """The k-th score of each group; the lowest number there is while a group has fewer."""
        return self.score[:, -1].reshape(-1, self.g)

    def add(self, group: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        touched = np.unique(group)
        held = self.score[touched] > NOTHING
        group = np.concatenate([np.repeat(touched, held.sum(1)), group])
        score, place = np.concatenate([self.score[touched][held], score]), np.concatenate([self.place[touched][held], place])
        order = np.lexsort((place, -score, group))
        group, score, place = group[order], score[order], place[order]
        first = np.searchsorted(group, group)
        nth = np.arange(len(group)) - first
        kept = nth < self.k
        self.score[touched], self.place[touched] = NOTHING, 0
        self.score[group[kept], nth[kept]], self.place[group[kept], nth[kept]] = score[kept], place[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, score, place) of all that is held."""
        group, nth = np.nonzero(self.score > NOTHING)
        return group, self.score[group, nth], self.place[group, nth]


def products(members: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (members @ rows.T).astype(np.int64)
    return members.astype(np.int64) @ rows.T.astype(np.int64)


def walk(members: np.ndarray, reach: np.ndarray, rows: np.ndarray, place: np.ndarray, order: np.ndarray, best: Best, wanted: Callable, floor: np.ndarray | None, exact: bool) -> int:
    """Fills ``best`` with what members find in a list, walked in ``order`` of falling bounds ``reach`` (for unit vectors).

    ``wanted(members' places, scores, rows' places)`` says, per group, which scores count; a group is done when its k-th score
    lies above anything behind, or its ``floor`` does.  Returns how many products were taken."""
    length = np.sqrt((members * members).sum(1))
    going, at, step, taken = np.arange(len(members)), 0, CHUNK, 0
    while at < len(order) and len(going):
        behind = length[going] * reach[order[at]]
        behind = behind + np.abs(behind) * RELATIVE
        open_ = best.last()[going] <= behind[:, None]
        if floor is not None:
            open_ &= floor[going] <= behind[:, None]
        going = going[open_.any(1)]
        if not len(going):
            break
        chunk = order[at : at + step]
        score = products(members[going], rows[chunk], exact)
        taken += score.size
        for j, counts in enumerate(wanted(going, score, chunk)):
            m, r = np.nonzero(counts & (score >= best.last()[going, j][:, None]))
            if len(m):
                best.add(going[m] * best.g + j, score[m, r], place[chunk[r]])
        at, step = at + step, min(2 * step, LONGEST)
    return taken


def column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name)
    return chunks.chunk(0) if chunks.num_chunks == 1 else pa.concat_arrays(chunks.chunks)


class Listed:
    """A list of rows in memory: vectors, lengths, labels, and their places in the order of ids, null last."""

    def __init__(self, part: pa.Table, width: int):
        ids = column(part, "id")
        by_id = np.asarray(pc.sort_indices(ids, null_placement="at_end"))  # ties go to the lower id
        self.place = np.empty(len(ids), np.int64)
        self.place[by_id] = np.arange(len(ids))
        self.ids = ids.take(pa.array(by_id))
        encoded = self.ids.dictionary_encode("encode")
        self.distinct, self.number = encoded.dictionary, np.empty(len(ids), np.int64)  # rows with equal ids have one number
        self.number[by_id] = np.asarray(encoded.indices)
        self.vectors, self.label = matrix(column(part, "q"), width), np.asarray(column(part, "label"))
        self.length = np.sqrt((self.vectors * self.vectors).sum(1))

    def number_of(self, ids: pa.Array) -> np.ndarray:
        """The number of each id among the list's; -1 for others."""
        return np.asarray(pc.index_in(ids, self.distinct, skip_nulls=False).fill_null(-1))


@lru_cache(maxsize=32)
def _block(folder: str, cluster: int, block: int) -> pa.Table | None:
    """Anchors of a block; None if their hash dealt it none."""
    import pyarrow.dataset as ds
    from pyarrow import fs as pafs

    fs, path = C.open_path(f"{folder}/cluster={cluster}/block={block}")
    return ds.dataset(path, filesystem=fs, format="parquet").to_table() if fs.get_file_info(path).type == pafs.FileType.Directory else None


def search(rows: DataFrame, anchors: str, clusters: list, centres: np.ndarray, width: int, kinds: dict, k: int, band: tuple[int, int] | None) -> DataFrame:
    """(anchor, target, id, score): the best k of each list of rows, per anchor of the folder ``anchors``; without ``band``
    rows of the anchor's label, with it, for each of the anchor's ``targets``, rows of other labels whose score s has
    band[0] * target <= band[1] * s and s <= target."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("target", T.IntegerType()), T.StructField("id", kinds["id"]), T.StructField("score", T.LongType())])

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        most, held, n = min(LIST_ROWS, max(1, LIST_NUMBERS // max(width, 1))), [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                if n + part.num_rows > most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lists(batches):
            rows_ = Listed(part.combine_chunks(), width)
            angles = np.arccos(cosines(rows_.vectors, rows_.length, centres))
            for cluster, opening, blocks, longest in clusters:
                reach = bounds(angles[:, cluster], rows_.length, opening)
                order = np.argsort(-reach, kind="stable")  # once for all members
                exact = longest * rows_.length.max() * 2 * max(band or (1, 1)) < 2**53
                for block in range(blocks):
                    table = _block(anchors, cluster, block)
                    if table is not None:
                        yield from find(table.combine_chunks(), rows_, reach, order, exact)

    def find(table: pa.Table, rows_: Listed, reach: np.ndarray, order: np.ndarray, exact: bool) -> Iterator[pa.RecordBatch]:
        members, own, mine = matrix(column(table, "q"), width), np.asarray(column(table, "label")), rows_.number_of(column(table, "id"))
        if band is None:
            best, floor = Best(len(members), 1, k), None

            def wanted(m, score, r):
                yield (own[m][:, None] == rows_.label[r][None, :]) & (mine[m][:, None] != rows_.number[r][None, :])
        else:
            targets = column(table, "targets")
            sizes = np.diff(targets.offsets.to_numpy())
            target = np.full((len(members), sizes.max(initial=1)), NOTHING)
            target[np.arange(target.shape[1])[None, :] < sizes[:, None]] = targets.flatten().to_numpy()
            there = target > NOTHING
            if band[0] < band[1]:
                there &= target >= 0  # below 0 the band is empty
            target = np.where(there, target, 0)
            best, floor = Best(len(members), target.shape[1], k), np.where(there, target * (band[0] / band[1]) * (1 - RELATIVE), np.inf)

            def wanted(m, score, r):
                other = own[m][:, None] != rows_.label[r][None, :]
                for j in range(target.shape[1]):
                    t = target[m, j][:, None]
                    yield other & there[m, j][:, None] & (score <= t) & (band[1] * score >= band[0] * t)

        walk(members, reach, rows_.vectors, rows_.place, order, best, wanted, floor, exact)
        group, score, at = best.rows()
        if len(group):
            anchor = column(table, "anchor").take(pa.array(group // best.g))
            yield pa.RecordBatch.from_arrays([anchor, pa.array((group % best.g).astype(np.int32)), rows_.ids.take(pa.array(at)), pa.array(score)], names=schema.names)

    return rows.mapInArrow(run, schema)


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives``
    best other rows of its label, the ``negatives`` best rows of other labels whose score is at most the positive's and at
    least band[0] / band[1] of it (all, if fewer); rank counts from 1.

    ``vector`` is an array<long>; a score is the inner product, higher scores come first, then smaller ids, null ids last.
    Rows with the anchor's id are the anchor, not other rows; repeated rows stand for themselves, and a repeated anchor is
    searched for as often; a row with a null label or vector takes no part, and no row with a null id is an anchor if
    ``is_anchor`` is null there.  Vectors of unequal length count as filled with zeros.  Scores are exact below 9e16.  Other
    columns are left out; an empty table, or one without anchors, gives an empty one.
    """
    spark = vectors.sparkSession
    shaped = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    rows = C.written(shaped.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<long>").alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("__anchor")), "vectors")
    kinds = {f.name: f.dataType for f in rows.schema}
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    asked = rows.where("__anchor")
    sample = asked.select("q").orderBy(F.xxhash64("q", "id"), "id").limit(FIT_ROWS).toArrow().column("q").combine_chunks()
    schema = f"anchor_id {kinds['id'].simpleString()}, positive_id {kinds['id'].simpleString()}, rank int, negative_id {kinds['id'].simpleString()}, positive_score long, negative_score long"
    if not len(sample) or not width:
        return spark.createDataFrame([], schema)
    centres = fit_centres(matrix(sample, width))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), width)
            length = np.sqrt((q * q).sum(1))
            cos = cosines(q, length, centres)
            nearest = cos.argmax(1)
            at = np.arccos(cos[np.arange(len(q)), nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(np.where(length > 0, at, 0.0)), pa.array(length)], names=[*batch.schema.names, "cluster", "angle", "length"])

    placed = asked.select("id", "label", "q").mapInArrow(place, T.StructType([*(rows.schema[c] for c in ("id", "label", "q")), T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("length", T.DoubleType())]))
    placed = C.written(placed.withColumn("anchor", F.monotonically_increasing_id()), "anchors")  # numbered once, then read
    stats = placed.groupBy("cluster").agg(F.max("angle").alias("opening"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy("cluster").collect()  # a row per centre
    clusters = [(r.cluster, r.opening, -(-r.n // BLOCK), r.longest) for r in stats]
    blocks = F.create_map(*(F.lit(x) for c, _, b, _ in clusters for x in (c, b)))

    def in_blocks(df: DataFrame, name: str) -> str:
        folder = C.new_folder(spark, name)
        cut = df.withColumn("block", F.pmod(F.xxhash64("anchor"), F.element_at(blocks, F.col("cluster"))).cast("int"))
        cut.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "anchor").write.partitionBy("cluster", "block").parquet(folder)
        return folder

    first = in_blocks(placed.select("anchor", "id", "label", "q", "cluster"), "anchor-blocks")
    close = C.written(best_of(search(rows, first, clusters, centres, width, kinds, positives, None), ["anchor"], positives), "positives")
    targets = close.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("targets"))  # positives at most
    aimed = placed.select("anchor", "id", "label", "q", "cluster").join(targets, "anchor", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<long>")))
    second = in_blocks(aimed, "target-blocks")
    found = best_of(search(rows, second, clusters, centres, width, kinds, negatives, band), ["anchor", "target"], negatives)
    named = close.select("anchor", (F.col("rank") - 1).alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(named, ["anchor", "target"]).join(placed.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
