"""Best-fit packing of token sequences after dominance reduction.

1. Documents become token ids, cut into pieces of at most ``capacity``; a table of (document, piece, length) is written.
2. All that packing has to know is how many pieces there are of each length: at most ``capacity`` counts, however large the
   corpus.  The plan is made over these counts, many equal sets at once: ``reduce_by_dominance`` fixes small sets that are
   provably at least as good as any other set that holds their largest piece, and ``best_fit`` places the rest.
3. A plan is a list of runs: "pieces lo..hi of this length go to these sequences".  Pieces get their rank among those of
   their length by shards (a shard's rank, after the counts of the shards before it), and are joined to the runs, which
   are bounded by ``capacity`` like the counts.

So every piece takes part in one packing of the whole corpus, no task holds more than a shard, and a lost task is computed
again with the same ranks.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Characters that are encoded together; words that a worker remembers (twice as many at most), and the longest of them.
BLOCK_CHARS, REMEMBERED, LONG_WORD, LONG_CHUNK = 1_000_000, 300_000, 64, 100_000


# ---- token ids


class WordTokenizer(dict):
    """Ids of texts as the tokenizer file gives them, without the special tokens that it would add.

    Its pieces never hold a space or a line feed, so a text's ids are those of the stretches between these, one after the
    other.  The dictionary holds the packed ids of stretches; one that is missing is made of known ones (its lower case; a
    word and the mark behind it), or goes through the file's merges, if the file's ids are in their order and all its
    characters lie below U+0250, where NFC and lower case are the same in every version of Unicode; or else through the
    tokenizer itself.  When the dictionary is full, what was not asked for since it was last full is forgotten.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.old = Tokenizer.from_file(path), {}
        special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        # what is left to the tokenizer: special tokens, separators that versions of \s differ in, other scripts
        self.apart = re.compile("|".join([*map(re.escape, special), "[\x1c-\x1f\x85]", "[^\0-\u024f]"])).search
        self.merges = _merges(path)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for t in texts:
            words, found = t.replace("\n", " ").split(" "), []
            for k in range(0, len(words), REMEMBERED):
                if len(self) > REMEMBERED:
                    self.old = dict(self)
                    self.clear()
                found.append(b"".join(map(self.__getitem__, words[k : k + REMEMBERED] if len(words) > REMEMBERED else words)))
            yield b"".join(found)

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = self._made(w)
        if len(w) <= LONG_WORD:
            self[w] = ids
        return ids

    def _made(self, w: str) -> bytes:
        if self.merges is None or self.apart(w):
            return b"".join(np.array(self.full.encode(part, add_special_tokens=False).ids, "<u4").tobytes() for part in _parts(w))
        low = w.lower()
        if low != w:
            return self[low]
        if w.isalpha():
            return array("I", self.merges(w.encode() + END)).tobytes()
        if w[-1:] in CLOSING and w[:-1].isalpha():
            return self[w[:-1]] + array("I", self.merges(w[-1:].encode() + END)).tobytes()
        ids = array("I")
        for piece in self.pieces(w):
            ids.extend(self.merges(piece.encode() + END))
        return ids.tobytes()


#: Marks that are a piece of their own behind letters, whatever follows.
CLOSING = frozenset(".,;:!?")
#: Stands for the end of a word; no UTF-8 text holds this byte.
END = b"\xff"


def _parts(w: str) -> Iterator[str]:
    """A very long stretch cut between a letter and a mark that follows it, where the tokenizer always cuts."""
    import regex

    if len(w) <= LONG_CHUNK or "<|" in w:
        yield w
        return
    first = 0
    for m in regex.finditer(r"(?<=\p{L})(?=[^\s\p{L}\p{N}\p{M}])", w):
        if m.start() - first >= LONG_CHUNK // 2:
            yield w[first : m.start()]
            first = m.start()
    yield w[first:]


def _merges(path: str):
    """A function from a piece's bytes and END to its ids, or None if ids do not follow the order of merges."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, of_char = model["vocab"], C.byte_characters()
    raw = lambda token: bytes(of_char[c] for c in token.removesuffix("</w>")) + (END if token.endswith("</w>") else b"")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ordered = [vocab.get(a + b) for a, b in pairs]
    singles = [c + end for end in ("", "</w>") for c in of_char]
    if model.get("end_of_word_suffix") != "</w>" or None in ordered or ordered != sorted(ordered) or any(c not in vocab for c in singles):
        return None
    # a last byte meets the end before anything else merges: those 256 pairs have the lowest ranks
    if max(vocab[c] for c in singles) >= min(ordered):
        return None
    ranks = {raw(c): vocab[c] for c in [*singles, *(a + b for a, b in pairs)]}
    spare = max(vocab.values()) + 1
    ranks.setdefault(END, spare)
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, block, size = 0, [], 0
    for i, t in enumerate(texts):
        block.append(t.as_py() or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): each document's ids and end_id, cut at capacity."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for first, block in _blocks(batch.column(1)):
                at, piece, start, length, crc, arrays = [], [], [], [], [], []
                for i, packed in enumerate(tokenizer.encode(block)):
                    packed += last
                    for k in range(0, len(packed), 4 * capacity):
                        part = packed[k : k + 4 * capacity]
                        at.append(first + i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            arrays.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(arrays, pa.list_(pa.int32()))] if ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


# ---- the plan over counts


class Lengths:
    """How many pieces of each length are left, and the lengths that are, in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect_left(self.order, length))

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The n smallest pieces longer than ``above``, fewer if there are fewer."""
        found: list[int] = []
        for i in range(bisect_right(self.order, above), len(self.order)):
            found += [self.order[i]] * min(n - len(found), self.count[self.order[i]])
            if len(found) == n:
                break
        return found

    def largest(self, most: int) -> int | None:
        i = bisect_right(self.order, most)
        return self.order[i - 1] if i else None

    def best_pair(self, most: int) -> int:
        """The largest sum of two pieces that is at most ``most``; 0 if no two fit."""
        a = np.array(self.order[: bisect_right(self.order, most)], np.int64)
        if not len(a):
            return 0
        place = np.searchsorted(a, most - a, "right") - 1
        single = np.array([self.count[x] == 1 for x in a.tolist()])
        place = place - ((place == np.arange(len(a))) & single)  # a piece doesn't pair with itself
        return int((a + a[place])[place >= 0].max(initial=0))


def dominating_set(left: Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """Pieces that share a sequence with one of length j at least as well as any others could; None where no rule tells.

    ``left`` no longer counts that piece.  A set F dominates a set S that also holds j if the other pieces of S can be dealt
    to those of F without a sum above the piece they are dealt to: a packing with S then has one with F that is as good, for
    what S held stands where F's pieces stood.
    * nothing else fits: {j}.
    * k is the largest piece that fits.  If it fills the sequence, or if no two others fit, or if no two that fit are longer
      than k together and no three fit: {j, k}, since all others of S go where k stood.
    * no three fit, and b is the largest that fits beside j and k: {j, k, b}, if no two pieces longer than b fit together,
      for then the shorter one of any two goes where b stood and the longer one where k stood.
    """
    room = capacity - j
    small = left.smallest(3)
    if not small or small[0] > room:
        return ()
    k = left.largest(room)
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) == 3 and sum(small) <= room:
        return None
    if left.best_pair(room) <= k:
        return (k,)
    left.take(k, 1)
    b = left.largest(room - k)
    longer = left.smallest(2, b) if b else []
    left.count[k] = left.count.get(k, 0) + 1
    if left.count[k] == 1:
        insort(left.order, k)
    if not b:
        return None
    if b < k:  # k itself is longer than b, too
        longer = sorted([*longer, k])[:2]
    return (k, b) if len(longer) < 2 or sum(longer) > room else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(fixed sets as ({length: pieces}, how many of them), counts of what is left), swept until no rule finds a set."""
    left, fixed, found = Lengths(counts), [], True
    while found:
        found = False
        for j in left.order[::-1]:
            while left.count.get(j):
                left.take(j, 1)
                others = dominating_set(left, j, capacity)
                left.count[j] = left.count.get(j, 0) + 1
                if left.count[j] == 1:
                    insort(left.order, j)
                if others is None:
                    break
                one = {x: [j, *others].count(x) for x in {j, *others}}
                # what is taken away only makes the smallest pieces longer, so the rule holds as long as the set can be had
                times = min(left.count[x] // n for x, n in one.items())
                for x, n in one.items():
                    left.take(x, n * times)
                fixed.append((one, times))
                found = True
    return fixed, left.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sets, and how many of each, as placing the pieces one by one, longest first, each into the fullest sequence that has
    room, gives them; equal sequences are handled together."""
    rooms: list[int] = []  # in order
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, held: dict[int, int], times: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((held, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                put(capacity, {}, -(-n // (capacity // length)))
                continue
            room = rooms[i]
            held, times = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(i)
            each = room // length  # a sequence that got one piece is the fullest, and gets the next
            full = min(times, n // each)
            if full:
                put(room - each * length, held | {length: each}, full)
                n -= full * each
            if n and full < times:
                put(room - n * length, held | {length: n}, 1)
                full, n = full + 1, 0
            if full < times:
                put(room, held, times - full)
    return [group for groups in bins.values() for group in groups if group[0]]


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, each, offset): pieces lo <= rank < hi of a length go, ``each`` by ``each``, to the sequences
    from ``sequence`` on, from ``offset`` on."""
    if any(k > capacity for k in counts):
        raise ValueError("a piece is longer than a sequence")
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for held, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, each in sorted(held.items(), reverse=True):
            lo = used.get(length, 0)
            used[length] = lo + each * times
            runs.append((length, lo, used[length], sequence, each, offset))
            offset += each * length
        sequence += times
    return runs


# ---- the operator


def with_rank(pieces: DataFrame, by: str, order: list[str], shard_rows: int) -> DataFrame:
    """pieces with __rank, from 0, among those of equal ``by``.  Values are cut into shards by a hash of the row, so that one
    value that holds most rows is ranked by many tasks; a shard starts after the rows of the shards before it."""
    total = pieces.count()
    shards = max(1, math.ceil(total / max(shard_rows, math.isqrt(total))))
    cut = pieces.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    sizes = cut.groupBy(by, "__shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = sizes.select(by, "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(by, "__shard").orderBy(*order)) - 1
    return cut.withColumn("__inside", inside).join(starts, [by, "__shard"]).withColumn("__rank", F.col("__start") + F.col("__inside")).drop("__shard", "__inside", "__start")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", ids: bool = True, shard_rows: int = 500) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``ids`` also ids, an array of int): a row per piece.

    A document's tokens are its ids and ``end_id``; null and empty texts have that one alone.  Only documents longer than
    ``capacity`` are cut.  Pieces of a sequence stand one after the other from offset 0 on, without a gap.  Repeated rows and
    rows with equal or null doc_id are documents of their own; other columns of docs are left out; an empty table gives an
    empty one.  ``path`` is a tokenizer file that every executor can open.
    """
    spark = docs.sparkSession
    pieces = C.written(token_pieces(docs, path, capacity, end_id, text, ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = spark.createDataFrame(plan_runs(counts, capacity), "r_length long, lo long, hi long, sequence long, each long, at long")
    ranked = with_rank(pieces, "length", ["piece", "start", "ids_crc32", "doc_id"], shard_rows)
    here = (F.col("length") == F.col("r_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi"))
    i = F.col("__rank") - F.col("lo")
    placed = ranked.join(F.broadcast(runs), here)  # bounded by capacity, whatever the corpus
    place = {"sequence_id": F.col("sequence") + F.floor(i / F.col("each")), "offset": F.col("at") + i % F.col("each") * F.col("length")}
    return placed.select(*pieces.columns, *(v.alias(k) for k, v in place.items()))
