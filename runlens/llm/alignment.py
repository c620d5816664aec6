"""Alignment of the tokens of two tokenizers by the bytes they cover, and the pairs of ids it links.

Both token lists of a text are lists of byte ends. Each end of the shorter list is sought in the longer one by galloping: from about
where it should be, steps grow twofold until they pass it, and a binary search settles the rest. An end found in both closes a group;
the ranks of neighbouring ends give the range of tokens that a token overlaps. Links are counted over the corpus and looked up again
by chunks of documents: a chunk asks for each of its different pairs once, so that neither all counts meet in one task nor all links
in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.byte_tokens import RANKS, VOCABULARY, byte_ids
from runlens.llm.texts import bounded_batches, text_of
from runlens.session import written

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Links after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_LINKS = 2_000_000
#: Ids of the second list are below 2 ** ID_BITS.
ID_BITS = 16


@dataclass
class Alignment:
    """Of token lists of several texts, given one after another: groups and links.

    ``link_a`` and ``link_b`` are numbers of tokens that overlap, in the order of the shorter list's tokens; ``group_a`` and
    ``group_b`` are the numbers of tokens after each group.
    """

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def gallop(short: np.ndarray, long: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """For each of the rising numbers in ``short`` how many of the rising numbers in ``long`` are smaller.

    All searches run side by side. Each begins at ``begin``, by default at its share of the longer list, and first doubles its step
    upward or downward.
    """
    size = len(long)
    if not len(short) or not size:
        return np.zeros(len(short), np.int64)
    # Everything before the lower bound is smaller, and nothing from the upper one on, once the search has passed.
    low = np.arange(len(short), dtype=np.int64) * size // len(short) if begin is None else begin
    high = low.copy()
    up = long[low] < short
    step = 1
    active = np.flatnonzero(up)
    while len(active):
        low[active] = high[active] + 1
        high[active] = np.minimum(size, high[active] + step)
        past = high[active] >= size
        inside = active[~past]
        active = inside[long[high[inside]] < short[inside]]
        step *= 2
    step = 1
    active = np.flatnonzero(~up)
    while len(active):
        high[active] = low[active]
        low[active] = np.maximum(0, low[active] - step)
        before = active[low[active] > 0]
        active = before[long[low[before]] >= short[before]]
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        smaller = long[middle] < short[active]
        low[active[smaller]] = middle[smaller] + 1
        high[active[~smaller]] = middle[~smaller]
        active = active[low[active] < high[active]]
    return low


def align(ends_a: np.ndarray, ends_b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> Alignment:
    """Groups and links of two rising lists of byte ends; where a text ends, both do. ``stops``: numbers of tokens after each text."""
    swap = len(ends_a) > len(ends_b)
    short, long, stop, stop_long = (ends_b, ends_a, stops_b, stops_a) if swap else (ends_a, ends_b, stops_a, stops_b)
    # A search begins at its share of its own text.
    number, other = np.diff(stop, prepend=0), np.diff(stop_long, prepend=0)
    share = np.arange(len(short)) - np.repeat(stop - number, number)
    begin = np.repeat(stop_long - other, number) + share * np.repeat(other, number) // np.repeat(number, number)
    rank = gallop(short, long, begin)
    common = np.zeros(len(short), bool)
    known = rank < len(long)
    common[known] = long[rank[known]] == short[known]
    first = np.zeros(len(short), np.int64)
    first[1:] = rank[:-1] + common[:-1]
    count = rank - first + 1
    link_short = np.repeat(np.arange(len(short)), count)
    link_long = np.arange(count.sum()) - (np.cumsum(count) - count)[link_short] + first[link_short]
    group_short, group_long = np.flatnonzero(common) + 1, rank[common] + 1
    return Alignment(group_long, group_short, link_long, link_short) if swap else Alignment(group_short, group_long, link_short, link_long)


class Tokens:
    """Both tokenizers, the bytes of their tokens, and the texts of ids with what follows them."""

    def __init__(self, vocabulary: str, ranks: str, pieces: str):
        self.a = byte_ids(vocabulary, ranks, False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = self.a.spelled()
        model = self.b
        self.bytes_b = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(model.get_piece_size())
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # Of each id: followed by one of its own list, by the other list, by the next group.
        self.written_a = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.written_b = [b"%d%s" % (i, end) for i in range(len(self.bytes_b)) for end in (b",", b";")]
        self.written = self.written_a + self.written_b

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both, or nothing where a text is empty or a tokenizer does not give it back."""
        spelled_a, spelled_b, out = self.bytes_a, self.bytes_b, []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            if not text:
                out.append(None)
                continue
            data = b" " + text.encode()
            a = self.a.encode(" " + text)
            same = b"".join([spelled_b[i] for i in b]) == data and b"".join([spelled_a[i] for i in a.tolist()]) == data
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
        return out


@cache
def tokens(vocabulary: str = VOCABULARY, ranks: str = RANKS, pieces: str = PIECES) -> Tokens:
    """Made once in each worker."""
    return Tokens(vocabulary, ranks, pieces)


def _described(own: Tokens, texts: list[str]) -> tuple[list[tuple], np.ndarray]:
    """Per text: numbers of tokens of both, of groups and links, and the digest of the groups; and the links of all as packed id pairs."""
    ids = own.encode(texts)
    some = [pair for pair in ids if pair is not None]
    if not some:
        return [(0, 0, 0, 0, "")] * len(texts), np.empty(0, np.int64)
    a, b = (np.concatenate([pair[k] for pair in some]) for k in (0, 1))
    stop_a, stop_b = np.cumsum([len(p[0]) for p in some]), np.cumsum([len(p[1]) for p in some])
    found = align(np.cumsum(own.sizes_a[a]), np.cumsum(own.sizes_b[b]), stop_a, stop_b)
    links = a[found.link_a] << ID_BITS | b[found.link_b]
    # The ids of all groups as texts in one list: a token of the first list stands behind the second list's tokens of earlier groups.
    size_a, size_b = np.diff(found.group_a, prepend=0), np.diff(found.group_b, prepend=0)
    place_a = np.arange(len(a)) + np.repeat(found.group_b - size_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(found.group_a, size_b)
    code = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[found.group_a - 1] = True
    last_b[found.group_b - 1] = True
    code[place_a] = 2 * a + last_a
    code[place_b] = 2 * b + last_b + len(own.written_a)
    shown = own.written
    groups = np.searchsorted(found.group_a, stop_a, side="right")
    link_stop = np.searchsorted(found.link_a, stop_a, side="left")
    rows, k, last = [], 0, (0, 0, 0, 0)
    for pair in ids:
        if pair is None:
            rows.append((0, 0, 0, 0, ""))
            continue
        now = (int(stop_a[k]), int(stop_b[k]), int(groups[k]), int(link_stop[k]))
        text = b"".join([shown[c] for c in code[last[0] + last[1] : now[0] + now[1]].tolist()])[:-1]
        rows.append((*(x - y for x, y in zip(now, last)), hashlib.sha256(text).hexdigest()))
        last, k = now, k + 1
    return rows, links


#: A chunk: what its documents have, and their links as numbers of its different pairs, the commonest first.
_CHUNK = (
    "chunk long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "links binary, wide boolean, pairs array<long>, numbers array<long>"
)


def chunks(docs: DataFrame, most: int = CHUNK_LINKS) -> DataFrame:
    """Aligned documents in chunks of about ``most`` links."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = _CHUNK.format(kind=kind.simpleString())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, number = tokens(), TaskContext.get().partitionId(), 0
        ids, rows, links, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            every = np.concatenate(links) if links else np.empty(0, np.int64)
            pairs, place, counts = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(pairs), np.uint32)
            rank[order] = np.arange(len(pairs), dtype=np.uint32)
            named = rank[place.reshape(-1)]
            wide = len(pairs) > 1 << 16
            columns = list(zip(*rows))
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()), pa.array([ids], pa.list_(batch.column(0).type)),
                 *(one(c, pa.int64()) for c in columns[:4]), one(columns[4], pa.string()),
                 pa.array([named.astype(np.uint32 if wide else np.uint16).tobytes()], pa.binary()), pa.array([wide]),
                 one(pairs[order], pa.int64()), one(counts[order], pa.int64())],
                ["chunk", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "links", "wide", "pairs", "numbers"])

        for batch in parts:
            found, held = _described(own, batch.column(1).to_pylist())
            ids += batch.column(0).to_pylist()
            rows += found
            links.append(held)
            total += len(held)
            if total >= most:
                yield closed()
                number, ids, rows, links, total = number + 1, [], [], [], 0
        if rows:
            yield closed()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def link_counts(chunked: DataFrame) -> DataFrame:
    """``pair`` (both ids in one number), its ``count`` of links over all chunks, and whether it is the highest of its second id."""
    shown = chunked.select(F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.numbers").alias("n"))
    counts = written(shown.groupBy("pair").agg(F.sum("n").alias("count")))
    second = F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("second")
    # One row for each id of a vocabulary: never more than 2 ** ID_BITS.
    best = counts.groupBy(second).agg(F.max("count").alias("most"))
    return counts.withColumn("second", second).join(F.broadcast(best), "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, most: int = CHUNK_LINKS) -> DataFrame:
    """Per row ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: zeros and an empty digest. Texts of
    any length are taken whole. Repeated rows stay and count each; links with equal counts are all the highest of their id. Columns
    beyond ``doc_id`` and ``text`` are not looked at. An empty table stays empty.
    """
    chunked = written(chunks(docs, most))
    asked = chunked.select("chunk", F.posexplode("pairs").alias("rank", "pair"))
    told = asked.join(link_counts(chunked), "pair").groupBy("chunk").agg(F.collect_list(F.struct("rank", "count", "best")).alias("told"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chunked.drop("pairs", "numbers").join(told.withColumnRenamed("chunk", "own"), F.col("chunk") == F.col("own"), "left").drop("chunk", "own")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n_links = row["n_links"].values.to_numpy()
                named = np.frombuffer(row["links"].as_py(), np.uint32 if row["wide"].as_py() else np.uint16)
                sums = np.zeros((2, len(n_links)), np.int64)
                if len(named):
                    rank, count, best = (x.to_numpy(zero_copy_only=False) for x in row["told"].values.flatten())
                    value = np.zeros((2, len(rank)), np.int64)
                    value[:, rank] = best, count
                    ends = np.cumsum(n_links)
                    running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(value[:, named], axis=1)], axis=1)
                    sums = running[:, ends] - running[:, ends - n_links]
                plain = [row[name].values for name in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*plain, pa.array(sums[0]), pa.array(sums[1]), row["digests"].values],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
