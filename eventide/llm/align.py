"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection of their ends.

1. Each text is encoded by both; a token's end is a byte offset.  The shorter list of ends is searched in the longer one,
   each search starting from where an earlier end was found: steps of 1, 2, 4, ... until they pass the value, then halving in
   between.  Ends in both lists cut the text into groups, and the places of a cut in the two lists say which tokens a group
   holds.  Searches run in lockstep over many ends: every 65,536th end first, then every 4,096th from the result before it,
   and so on down to every end.
2. A link is a pair of tokens that end together, so one token's bytes end with the other's: whatever the corpus, there
   are no more pairs of ids than the vocabularies have suffixes in common.  Documents keep their distinct pairs; Spark counts
   them corpus-wide, and the counts, bounded by the vocabularies, are broadcast to the documents' table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Characters of texts that are encoded together, and from which a text is encoded part by part.
BLOCK_CHARS, PART_CHARS = 1_000_000, 200_000
#: Each level of searches starts from the results of the one before it, which took every so many ends.
STRIDES = (65536, 4096, 256, 16, 1)

#: Fixed value: the pattern by which byte-level tokenizer files split text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE tokenizer file: ids of texts, special tokens being ordinary text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of_char, vocab, split = C.byte_characters(), file["model"]["vocab"], file.get("pre_tokenizer") or {}
        bytes_of = {i: bytes(map(of_char.get, token)) if all(c in of_char for c in token) else token.encode() for token, i in vocab.items()}
        bytes_of |= {i: t.content.encode() for i, t in self.full.get_added_tokens_decoder().items()}
        self.tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in file["model"]["merges"]]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file.get("normalizer")
        singles = [vocab.get(c) for c in of_char]
        self.direct = None
        if plain and None not in merged and None not in singles and merged == sorted(merged) and max(singles) < min(merged):
            # ids follow the order of merges, so the lowest id goes first, as in a rank file
            ranks = {self.tokens[i]: i for i in [*singles, *merged]}
            self.direct = tiktoken.Encoding("aligned", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, part: str) -> list[int]:
        # a run of half a million spaces is too much for the direct way's pattern
        return self.direct(part) if self.direct and len(part) < 2 * PART_CHARS else self.full.encode(part, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model, which puts a space before each text: ids and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: whether a space starts a piece wherever it stands behind another character, so that texts can be cut there
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, part: str) -> list[int]:
        return self.model.encode(part[1:])


@lru_cache(maxsize=2)
def _both(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def _parts(spaced: str) -> Iterator[str]:
    """A long text cut before single spaces between other characters; both tokenizers start a token there in any case."""
    first = 0
    while len(spaced) - first > PART_CHARS:
        cut = spaced.find(" ", first + PART_CHARS // 2)
        while 0 <= cut and (spaced[cut - 1].isspace() or cut + 1 == len(spaced) or spaced[cut + 1].isspace()):
            cut = spaced.find(" ", cut + 1)
        if cut < 0:
            break
        yield spaced[first:cut]
        first = cut
    yield spaced[first:]


def encode_both(text: str, a: ByteLevel, b: Pieces) -> tuple[list[int], list[int]]:
    """Ids of space + text by both; two empty lists if the text is empty or their bytes are not those of space + text."""
    if not text:
        return [], []
    spaced, ids_a, ids_b = " " + text, [], []
    for part in _parts(spaced) if b.cuts else [spaced]:
        ids_a += a.encode(part)
        ids_b += b.encode(part)
    raw = spaced.encode()
    same = b"".join(map(a.tokens.__getitem__, ids_a)) == raw and b"".join(map(b.tokens.__getitem__, ids_b)) == raw
    return (ids_a, ids_b) if same else ([], [])


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short`` the place of the first of ``long`` that is not below it; both ascend, long ends no lower."""
    at = np.zeros(len(short), np.int64)
    above = 0
    for stride in STRIDES:
        mine = np.arange(0, len(short), stride)
        if above:
            mine = mine[mine % above != 0]
            start = at[mine - mine % above]
        else:
            start = np.zeros(len(mine), np.int64)
        at[mine] = _search(short[mine], long, start)
        above = stride
    return at


def _search(values: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    found = start.copy()
    open_ = np.flatnonzero(long[start] < values)  # places below their value
    low, high, v, width = start[open_], None, values[open_], 1
    ends = np.empty(len(open_), np.int64)
    going = np.arange(len(open_))
    while len(going):  # doubling steps
        reach = np.minimum(start[open_[going]] + width, len(long) - 1)
        below = long[reach] < v[going]
        ends[going] = reach
        low[going[below]] = reach[below]
        going, width = going[below], width * 2
    high = ends
    going = np.flatnonzero(high - low > 1)
    while len(going):  # halving
        middle = (low[going] + high[going]) >> 1
        below = long[middle] < v[going]
        low[going[below]] = middle[below]
        high[going[~below]] = middle[~below]
        going = going[high[going] - low[going] > 1]
    found[open_] = high
    return found


class Aligner:
    """Groups and links of blocks of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _both(path_a, path_b)
        self.len_a, self.len_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        # a token and what follows it: "," inside its group; "|" or ";" at its end; nothing at the end of the text
        self.said = [f"{i}{end}" for i in range(len(self.len_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.len_b)) for end in (",", ";", "")]

    def block(self, texts: list[str]) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
        """(row per text, then text's place, pair and number of each of the texts' distinct linked pairs, by place)."""
        pairs = [encode_both(t, self.a, self.b) for t in texts]
        rows = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""} for _ in texts]
        keys = []
        for a_drives in (True, False):
            chosen = [i for i, (x, y) in enumerate(pairs) if x and (len(x) <= len(y)) == a_drives]
            if chosen:
                keys.append(self._align(chosen, pairs, a_drives, rows))
        place, pair, n = (np.concatenate(x) if keys else np.zeros(0, np.int64) for x in (zip(*keys) if keys else ((), (), ())))
        order = np.argsort(place, kind="stable")
        return rows, place[order], pair[order], n[order]

    def _align(self, chosen: list[int], pairs: list, a_drives: bool, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes_a, sizes_b = (np.array([len(pairs[i][k]) for i in chosen], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter((x for i in chosen for x in pairs[i][k]), np.int64, int(n.sum())) for k, n in ((0, sizes_a), (1, sizes_b)))
        # texts stand one after the other, so ends ascend across them, and a text's last ends meet
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        short, long = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
        at = gallop(short, long)
        both = np.flatnonzero(long[at] == short)
        cut_a, cut_b = (both, at[both]) if a_drives else (at[both], both)
        upto_a, upto_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        text_of = np.searchsorted(upto_a, cut_a, "right")
        groups = np.bincount(text_of, minlength=len(chosen))
        # tokens in the order in which a text's groups name them
        before_b, after_a = np.concatenate([[0], cut_b[:-1] + 1]), cut_a + 1
        in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        said = np.empty(len(ids_a) + len(ids_b), np.int64)
        code_a, code_b = ids_a * 2, ids_b * 3 + 2 * len(self.len_a)
        code_a[cut_a] += 1
        code_b[cut_b] += 1
        code_b[upto_b - 1] += 1
        said[np.arange(len(ids_a)) + np.repeat(before_b, in_a)] = code_a
        said[np.arange(len(ids_b)) + np.repeat(after_a, in_b)] = code_b
        flat, first = said.tolist(), 0
        for k, (i, last) in enumerate(zip(chosen, (upto_a + upto_b).tolist())):
            n = int(groups[k])
            rows[i] = {"n_a": int(sizes_a[k]), "n_b": int(sizes_b[k]), "n_groups": n, "n_links": n, "groups": "".join(map(self.said.__getitem__, flat[first:last]))}
            first = last
        # tokens have bytes, so one token of each list ends at an offset: a link per cut
        pair, room = ids_a[cut_a] * len(self.len_b) + ids_b[cut_b], len(self.len_a) * len(self.len_b)
        keys, n = np.unique(text_of * room + pair, return_counts=True)
        return np.array(chosen, np.int64)[keys // room], keys % room, n


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


def links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, and groups if asked for): ``pairs`` are a document's
    distinct linked ids (id of A times the size of B's vocabulary, plus id of B), ``times`` how often each is linked in it."""
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())), *([T.StructField("groups", T.StringType())] if groups else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for first, block in _blocks(batch.column(1)):
                rows, place, pair, n = aligner.block(block)
                offsets = pa.array(np.searchsorted(place, np.arange(len(block) + 1)), pa.int32())
                said = [r["groups"] for r in rows]
                columns = [
                    batch.column(0).slice(first, len(block)), *(pa.array([r[c] for r in rows], pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32), pa.int32())), *([pa.array(said, pa.string())] if groups else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold a pair of ids, and whether that is the most for its id of B."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("t"))
    counts = each.groupBy("pair").agg(F.sum("t").alias("n"))
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair") % size_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``groups`` also groups, such as
    ``a1,a2|b1;a3|b2``): the tokens of each text by tokenizer A (a byte-level file) and B (a sentencepiece model), aligned.

    A gets a space and the text, B the text, before which it puts a space itself; special tokens are ordinary text.  Texts that
    are null or empty, or whose tokens do not spell a space and the text, have no tokens: zeros and ''.  n_best are the links
    whose pair of ids is linked at least as often, corpus-wide, as any other pair with its id of B; count_sum adds the
    corpus-wide count over links.  Texts of any length are taken whole; repeated rows and rows with equal or null doc_id
    are documents of their own, and count each; other columns of docs are left out; an empty table gives an empty one.
    """
    linked = C.written(links(docs, path_a, path_b, text, groups), "links")
    counted = pair_counts(linked, len(_both(path_a, path_b)[1].tokens)).toPandas()  # bounded by the vocabularies' common suffixes
    counted = counted.sort_values("pair")
    known = docs.sparkSession.sparkContext.broadcast(tuple(counted[c].to_numpy(k) for c, k in (("pair", np.int64), ("n", np.int64), ("best", np.int64))))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    last = ["groups_sha256", *(["groups"] if groups else [])]
    schema = T.StructType([*(linked.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *(linked.schema[c] for c in last)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            offsets = batch.column("pairs").offsets.to_numpy()
            held, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            which = np.searchsorted(pairs, held)
            offsets = offsets - offsets[0]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            sums = (total(best[which] * times), total(counts[which] * times)) if len(held) else (np.zeros(batch.num_rows, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in sums), *(batch.column(c) for c in last)], names=schema.names)

    return linked.mapInArrow(run, schema)
