"""Byte-level BPE by corpus-level merge replay.

1. The distinct pieces of the whole corpus (matches of the split pattern) are counted by a Spark aggregation.  Those that
   stand in most places, about ``dictionary`` of them, are dealt to shards.  A shard is laid out as one corpus of bytes,
   and an inverted index maps each pair's rank to the places where the pair stands.  Merges are replayed in rank order
   over that index: a merge joins two neighbours and touches only the pairs left and right of it.
2. Documents are a lookup per piece.  A piece outside the dictionary is rare: it is replayed, by the same index, with the
   other new pieces of the block of text where it stands.

No text is shuffled, a worker holds the dictionary, one block and a bounded memory of the blocks before it, whatever the
size of the corpus, and a lost task replays its own blocks alone.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bounds of a worker's memory: characters of a block; bytes laid out at once; pieces that a task remembers from block to
#: block, and their characters; pieces that it gathers before it hands them on to be counted.
BLOCK_CHARS, LAYOUT, REMEMBERED, REMEMBERED_CHARS, GATHERED = 1_000_000, 1_000_000, 100_000, 8_000_000, 300_000
#: Characters from which a text is split bit by bit, and a piece is too long for the dictionary.
STREAMED, LONG = 1_000_000, 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> tuple[np.ndarray, dict[int, int], list[bytes], np.ndarray, np.ndarray]:
    """The id of each byte; of each mergeable pair of ids (packed) the rank of what it gives; the bytes of each id; and by
    two bytes (the first one times 256 plus the second) the rank of what they give, and whether any token holds them."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
    of_byte = [ranks[bytes([x])] for x in range(256)]
    first = np.array([pairs.get(x << 32 | y, -1) for x in of_byte for y in of_byte], np.int32)
    inside = np.zeros(1 << 16, bool)
    inside[[x << 8 | y for token in tokens for x, y in zip(token, token[1:])]] = True
    return np.array(of_byte, np.int32), pairs, tokens, first, inside


def replay(words: list[bytes], path: str) -> Iterator[bytes]:
    """The packed ids of each word, as merging the pair of the lowest rank, leftmost first, again and again gives them.

    A word longer than a layout is cut between bytes that no token holds side by side: no merge crosses such a place.  What
    has none, say a run of one letter, is laid out whole, in some 40 bytes of arrays per byte.
    """
    now, size = [], 0
    for w in words:
        if len(w) > LAYOUT:
            yield from _replay(now, path) if now else ()
            now, size = [], 0
            yield b"".join(ids for part in _parts(w, path) for ids in _replay([part], path))
            continue
        now.append(w)
        size += len(w)
        if size >= LAYOUT:
            yield from _replay(now, path)
            now, size = [], 0
    yield from _replay(now, path) if now else ()


def _parts(word: bytes, path: str) -> Iterator[bytes]:
    """The word in parts of at most LAYOUT bytes where it can be cut so, else of as few more as it allows."""
    inside, data, start = _vocabulary(path)[4], np.frombuffer(word, np.uint8), 0
    cuts = np.append(np.flatnonzero(~inside[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1, len(word))
    while start < len(word):
        k = np.searchsorted(cuts, start + LAYOUT, "right") - 1
        end = int(cuts[k] if k >= 0 and cuts[k] > start else cuts[k + 1])
        yield word[start:end]
        start = end


def _replay(words: list[bytes], path: str) -> list[bytes]:
    of_byte, pairs, _, first, _ = _vocabulary(path)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    corpus = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    start = of_byte[corpus]
    start[ends] = -1  # no pair crosses a word
    n = len(start)
    ids, after, before = array("i"), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    ids.frombytes(start.view(np.uint8))
    del start
    index, get = _first_pairs(corpus, ends, first), pairs.get
    queue = sorted(index)

    def note(rank: int, place: int) -> None:
        places = index.get(rank)
        if places is None:
            index[rank] = array("i", (place,))
            heappush(queue, rank)
        else:
            places.append(place)

    while queue:
        rank = heappop(queue)
        places = _in_order(index.pop(rank))
        for p in places:
            q = after[p]
            b = ids[q]
            if b < 0 or ids[p] < 0 or get(ids[p] << 32 | b) != rank:
                continue  # a neighbour was merged away meanwhile
            ids[p], ids[q] = rank, -2
            after[p] = r = after[q]  # a word's end follows its last byte, so r is a place
            before[r] = p
            lower = False
            if ids[r] >= 0 and (new := get(rank << 32 | ids[r])) is not None:
                note(new, p)
                lower = new < rank
            o = before[p]
            if o >= 0 and ids[o] >= 0 and (new := get(ids[o] << 32 | rank)) is not None:
                note(new, o)
                lower = lower or new < rank
            if lower:  # a pair of a lower rank came up: it goes first, the rest of this rank waits
                for rest in places:
                    note(rank, rest)
                break
    merged = np.frombuffer(ids, np.int32)
    upto = np.cumsum(merged >= 0)[ends] * 4
    packed = merged[merged >= 0].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]


def _first_pairs(corpus: np.ndarray, ends: np.ndarray, first: np.ndarray) -> dict[int, array]:
    """The places of each pair of neighbouring bytes, by rank; none that holds a word's end."""
    ranks = first[corpus[:-1].astype(np.uint16) << 8 | corpus[1:]]
    ranks[ends[:-1]] = -1
    ranks[ends[ends > 0] - 1] = -1
    places = np.flatnonzero(ranks >= 0).astype(np.int32)
    ranks = ranks[places]
    order = np.argsort(ranks, kind="stable")
    present, starts = np.unique(ranks[order], return_index=True)
    return {r: array("i", x.tobytes()) for r, x in zip(present.tolist(), np.split(places[order], starts[1:]))}


def _in_order(places: array) -> Iterator[int]:
    """The places from the smallest on; many are never all held as numbers of their own."""
    if len(places) < GATHERED:
        return iter(sorted(places))
    whole = np.sort(np.frombuffer(places, np.int32))
    return (p for a in range(0, len(whole), GATHERED) for p in whole[a : a + GATHERED].tolist())


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


def _splitter(pattern: str):
    """A function that gives the pieces of a text; those of a very long text are never all held at once."""
    import regex

    split = regex.compile(pattern)
    return lambda t: split.findall(t) if len(t) < STREAMED else (m[0] for m in split.finditer(t))


@lru_cache(maxsize=1)
def _dictionary(path: str) -> dict[str, bytes]:
    import pyarrow.dataset as ds

    fs, folder = C.open_path(path)
    return {piece: ids for b in ds.dataset(folder, filesystem=fs, format="parquet").to_batches() for piece, ids in zip(b.column("piece").to_pylist(), b.column("ids").to_pylist())}


class Encoder:
    """Texts to packed ids, by the corpus's dictionary and a memory of the pieces outside it."""

    def __init__(self, path: str, pattern: str, dictionary: dict[str, bytes]):
        self.path, self.split, self.ranks, self.dictionary = path, _splitter(pattern), load_ranks(path), dictionary
        self.forget()

    def forget(self) -> None:
        self.numbers, self.packed, self.chars = _Numbers(), [], 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, after every piece of the texts was learned."""
        if len(self.packed) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        number = self.numbers.__getitem__
        rows = [array("I", map(number, self.split(t))) for t in texts]
        new = list(islice(self.numbers, len(self.packed), None))
        known = [self.dictionary.get(piece) or self._single(piece) for piece in new]
        merged = replay([piece.encode() for piece, ids in zip(new, known) if ids is None], self.path)
        self.packed += [next(merged) if ids is None else ids for ids in known]
        self.chars += sum(map(len, new))
        return (b"".join(map(self.packed.__getitem__, row)) for row in rows)

    def _single(self, piece: str) -> bytes | None:
        rank = self.ranks.get(piece.encode())
        return None if rank is None else rank.to_bytes(4, "little")


def decode(ids: bytes, path: str) -> bytes:
    tokens = _vocabulary(path)[2]
    numbers = np.frombuffer(ids, "<u4")
    return b"".join(b"".join(map(tokens.__getitem__, numbers[a : a + GATHERED].tolist())) for a in range(0, len(numbers), GATHERED))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows, of BLOCK_CHARS characters or one text more."""
    first, block, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block


def learn_dictionary(docs: DataFrame, path: str, pattern: str, text: str, dictionary: int) -> str:
    """Writes (piece, ids) of the corpus's most widespread pieces that are no token themselves, about ``dictionary`` of
    them, to the shared folder; its path.

    Pieces that stand in one part of the corpus only, or that are very long, gain nothing by it and are left out.
    """

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ranks, seen = _splitter(pattern), load_ranks(path), set()
        give = lambda: pa.RecordBatch.from_arrays([pa.array([x for x in seen if len(x) <= LONG and x.encode() not in ranks], pa.string())], names=["piece"])
        for batch in batches:
            for t in batch.column(0):
                seen.update(split(t.as_py() or ""))
                if len(seen) >= GATHERED:
                    yield give()
                    seen.clear()
        yield give()

    counted = docs.select(text).mapInArrow(gather, "piece string").groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = C.written(counted.select("piece", "n", F.floor(F.log2("n") * 8).cast("int").alias("level")), "pieces")
    # whole levels of counts while they have room, and of the next one a share by hash; a level is an eighth of a doubling
    least, share, room = 0, 0, dictionary
    for level, n in sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if n > room:
            least, share = level + 1, 1000 * room // n
            break
        room -= n
    chosen = counted.where((F.col("level") >= least) | (F.col("level") == least - 1) & (F.pmod(F.xxhash64("piece"), F.lit(1000)) < share))

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(0)
            yield pa.RecordBatch.from_arrays([pieces, pa.array(list(replay([p.encode() for p in pieces.to_pylist()], path)), pa.binary())], names=["piece", "ids"])

    folder = C.new_folder(docs.sparkSession, "dictionary")
    chosen.select("piece").repartition(1 + (dictionary >> 14), "piece").mapInArrow(shard, "piece string, ids binary").write.parquet(folder)
    return folder


def bpe(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, dictionary: int = 1 << 18) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256; with
    ``ids`` also token_ids, an array of int.

    Special tokens do not exist: their strings are ordinary text.  Null and empty texts have no ids; texts of any length
    are encoded whole; repeated rows and extra columns pass through, and columns called like the new ones are replaced;
    an empty table gives an empty one.  ``path`` is a rank file that every executor can open (it ships with the package
    that the cluster installs).
    """
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | ({"token_ids": T.ArrayType(T.IntegerType())} if ids else {})
    source = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    schema = T.StructType([*source.schema, *(T.StructField(k, v) for k, v in new.items())])
    learned = learn_dictionary(source, path, pattern, text, dictionary)
    kinds = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern, _dictionary(learned))
        for batch in batches:
            for first, block in _blocks(batch.column(text)):
                rows: dict[str, list] = {c: [] for c in new}
                for packed in encoder.encode(block):
                    rows["n_tokens"].append(len(packed) // 4)
                    rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decode(packed, path)).hexdigest())
                    if ids:
                        rows["token_ids"].append(np.frombuffer(packed, "<u4").astype(np.int32))
                columns = [*batch.slice(first, len(block)).columns, *(pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return source.mapInArrow(run, schema)
