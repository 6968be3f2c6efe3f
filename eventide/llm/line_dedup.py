"""Line dedup: probe a sharded minimal perfect hash over line hashes instead of joining lines.

1. Spark counts, for each line key, the documents that hold it (distinct keys per row, one partial aggregation).
2. Keys found in at least ``min_docs`` documents are dealt by hash to shards.  Each shard becomes one row of an index
   table: a minimal perfect hash (levels of bit arrays, a key stays at the first level where it collides with no other)
   that numbers its keys, a fingerprint array and a count array.
3. Documents carry only their line hashes to the probe; a task loads a shard when a line of its batch falls into it.

A key is 128 bits: 64 place it, the other 64 are the fingerprint, so a line outside the index is recognised as such.
Keys in fewer documents change no decision and are left out, so the index holds at most lines / min_docs keys.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 40


def _mixed(h: np.ndarray, fp: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (fp + np.uint64(level + 1)) * _MIX
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def build_shard(h: np.ndarray, fp: np.ndarray, counts: np.ndarray) -> dict:
    """The index of distinct (h, fp) keys: bit arrays by level, then fingerprints and counts in the numbering they give."""
    left, bits, sizes, order = np.arange(len(h)), [], [], []
    for level in range(_LEVELS):
        if not len(left):
            break
        m = max(64, -(-int(len(left) * 1.5) // 64) * 64)
        at = (_mixed(h[left], fp[left], level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        level_bits = np.zeros(m, np.uint8)
        level_bits[at[alone]] = 1
        order.append(left[alone][np.argsort(at[alone])])
        bits.append(level_bits)
        sizes.append(m)
        left = left[~alone]
    order.append(left)  # keys that never parted; the probe scans them
    order = np.concatenate(order).astype(np.int64)
    return {"bits": np.packbits(np.concatenate([*bits, np.zeros(0, np.uint8)])).tobytes(), "sizes": sizes, "rest": len(left), "fingerprints": fp[order].tobytes(), "hashes": h[order[len(order) - len(left):]].tobytes(), "counts": counts[order].astype(np.int64).tobytes()}


class Shard:
    def __init__(self, row: dict):
        self.sizes, self.rest = list(row["sizes"]), row["rest"]
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.fp, self.counts = np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.int64)
        self.rest_h = np.frombuffer(row["hashes"], np.uint64)

    def count(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for those outside."""
        out, left, start = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        for level, m in enumerate(self.sizes):
            at = start + (_mixed(h[left], fp[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            slot = self.rank[at[hit]]
            out[left[hit]] = np.where(self.fp[slot] == fp[left[hit]], self.counts[slot], 0)
            left, start = left[~hit], start + m
        for k in range(self.rest):
            slot = len(self.fp) - self.rest + k
            out[left[(h[left] == self.rest_h[k]) & (fp[left] == self.fp[slot])]] = self.counts[slot]
        return out


@lru_cache(maxsize=64)
def _shard(path: str, number: int) -> Shard | None:
    import pyarrow.dataset as ds

    fs, folder = C.open_path(path)
    rows = ds.dataset(f"{folder}/shard={number}", filesystem=fs, format="parquet").to_table().to_pylist() if fs.get_file_info(f"{folder}/shard={number}").type.name == "Directory" else []
    return Shard(rows[0]) if rows else None


_INDEX_ROW = "shard long, bits binary, sizes array<long>, rest long, fingerprints binary, hashes binary, counts binary"


def _line_keys(text: Column, min_chars: int) -> Column:
    """(a, b) hash of each line's key in line order; null where the key is too short to count."""
    return F.transform(F.split(C.ascii_lower(text), "\n"), lambda x: C.let(F.btrim(x, F.lit(C.SPACE_CHARS)), lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b")))))


def build_index(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, shard_keys: int = 200_000) -> tuple[str, int]:
    """Writes the index table to the shared folder; its path and number of shards."""
    spark = docs.sparkSession
    keys = docs.select(F.explode(F.array_distinct(_line_keys(C.whole(text), min_chars))).alias("k")).where("k IS NOT NULL")
    frequent = C.written(keys.groupBy("k.a", "k.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs), "line-counts")
    shards = max(1, -(-frequent.count() // shard_keys))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        row = build_shard(group["a"].to_numpy().view(np.uint64), group["b"].to_numpy().view(np.uint64), group["n"].to_numpy())
        return pd.DataFrame([row | {"shard": group["shard"].iloc[0]}])[[x.split()[0] for x in _INDEX_ROW.split(", ")]]

    path = C.new_folder(spark, "line-index")
    by_shard = frequent.withColumn("shard", F.expr(f"pmod(shiftright(a, 8), {shards})"))
    by_shard.groupBy("shard").applyInPandas(build, _INDEX_ROW).write.partitionBy("shard").parquet(path)
    return path, shards


def line_dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, shard_keys: int = 200_000) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the text without the lines whose key stands in min_docs rows or more.

    A key is the line stripped of ASCII white space at both ends, A-Z in lower case.  Null and empty texts are one empty
    line, which stays (its key is shorter than min_chars); a row that is repeated counts as another document; an empty
    table gives an empty table; a line may be of any length; other columns pass through, also those called like the new
    ones would be, which are replaced.
    """
    path, shards = build_index(docs, text, min_docs, min_chars, shard_keys)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def frequent(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([np.zeros(0, bool)] * len(a))
        h, fp = (np.concatenate([np.asarray(x, np.int64) for x in c]).view(np.uint64) for c in (a, b))
        number = (h.view(np.int64) >> 8) % shards
        hit = np.zeros(len(h), bool)
        for k in np.unique(number):
            if shard := _shard(path, int(k)):
                of = number == k
                hit[of] = shard.count(h[of], fp[of]) >= min_docs
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    no_key = F.lit(0)  # of lines too short to count; no shard holds it
    keyed = docs.select(*kept, C.let(_line_keys(C.whole(text), min_chars), lambda k: F.struct(F.transform(k, lambda x: F.coalesce(x["a"], no_key)).alias("a"), F.transform(k, lambda x: F.coalesce(x["b"], no_key)).alias("b"))).alias("__keys"))
    probed = keyed.withColumn("__hit", frequent("__keys.a", "__keys.b"))
    dropped = F.filter(F.split(C.whole(text), "\n"), lambda x, i: ~F.col("__hit")[i])
    return probed.select(
        *kept,
        F.size("__hit").cast("long").alias("n_lines"),
        F.size(F.filter("__hit", lambda x: x)).cast("long").alias("n_dropped"),
        F.when(F.array_contains("__hit", True), F.array_join(dropped, "\n")).otherwise(C.whole(text)).alias("kept_text"),
    )
