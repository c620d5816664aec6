"""SimHash near-duplicates through an inverted index of fingerprint bytes.

Fingerprints that differ in at most four bits agree in four of their eight bytes at least. The index therefore has a posting for
each fingerprint under bytes and their positions, pairs of a posting list are tallied by the positional bytes they share, those with
four or more are kept, and the bits decide. A list of one byte would hold 1/256 of all rows, so lists are intersected
three at a time: of the twenty triples in ``TRIPLES`` any four positions contain one. A list that is still long is dealt
anew by a fourth byte, then by three and four nibbles of what is left, which leaves 16 free bits and so at most 65,536 entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import components
from runlens.llm.texts import bounded_batches, by_batch, only, text_of, utf8
from runlens.session import written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Positional units that two fingerprints within ``MOST_BITS`` share at least, of eight.
LEAST_SHARED = 8 - MOST_BITS
#: Entries of a posting list that are compared at once; longer lists are dealt anew.
LIST_LIMIT = 8192
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _triples() -> tuple[tuple[int, int, int], ...]:
    """Positions in three groups: triples within a group, or two of a group and one of the next. Any four positions hold one."""
    found = []
    for own, after in zip(_GROUPS, _GROUPS[1:] + _GROUPS[:1]):
        found += list(combinations(own, 3))
        found += [(*pair, one) for pair in combinations(own, 2) for one in after]
    return tuple(tuple(sorted(t)) for t in found)


TRIPLES = _triples()


def fingerprint(data: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    begins, stops = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(begins, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Tally of shared positional bytes first, then the bits of those that reach the least number."""
    differ = np.bitwise_xor(one, other)
    near = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED
    near[near] = np.bitwise_count(differ[near].view(np.uint64)) <= MOST_BITS
    return near


def _tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that are near each other in one list: each entry is reached once, and compared with those not reached yet."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            own = queue.pop()
            while len(own) and len(rest):
                near = _near(np.broadcast_to(own[:1], rest.shape).copy(), rest)
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), own[0]))
                    right.append(found)
                    queue.append(found)
                    rest = rest[~near]
                own = own[1:]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _lists(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each of many lists, given one after another."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    left, right = [], []
    for at, size in zip(first[sizes > 48], sizes[sizes > 48]):
        a, b = _tree(fps[at : at + size])
        left.append(a)
        right.append(b)
    short = (sizes > 1) & (sizes <= 48)
    stop = np.repeat((first + sizes)[short], sizes[short])
    at = np.flatnonzero(np.repeat(short, sizes))
    for step in range(1, 48):
        live = at + step < stop
        at, stop = at[live], stop[live]
        if not len(at):
            break
        near = _near(fps[at], fps[at + step])
        left.append(fps[at[near]])
        right.append(fps[at[near] + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _compare(rows: DataFrame, limit: int) -> DataFrame:
    """Links of all posting lists; rows of lists over ``limit`` come back as they are. Columns ``a``, ``b``, ``path`` (null: a link)."""
    owner = __name__

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        names, long = ["a", "b", "path"], None  # long: the key of the list that has passed the limit
        keys, fps, paths = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

        def linked(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32())], names)

        for part in parts:
            new = [part.column(c).to_numpy() for c in ("key", "fp", "path")]
            keys, fps, paths = np.concatenate([keys, new[0]]), np.concatenate([fps, new[1]]), np.concatenate([paths, new[2]])
            if not len(keys):
                continue
            done = int(np.searchsorted(keys, keys[-1]))  # rows before the last list, which may go on
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            sizes = np.diff(np.append(np.flatnonzero(first), len(keys)))
            hot = np.repeat(sizes > limit, sizes) | (keys == long if long is not None else False)
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[hot]), pa.array(keys[hot]), pa.array(paths[hot])], names)
            long = keys[-1] if hot[-1] else None
            ready = ~hot
            ready[done:] = False
            yield linked(*_lists(keys[ready], fps[ready]))
            keep = np.zeros(len(keys), bool)
            keep[done:] = ~hot[done:]
            keys, fps, paths = keys[keep], fps[keep], paths[keep]
        yield linked(*_lists(keys, fps))

    bounded_batches(rows.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, path int")


def _dealt_anew(hot: DataFrame, level: int) -> DataFrame:
    """Posting rows of long lists under one more byte (level 1), three nibbles of the other bytes (2), or one more nibble (3).

    ``path`` says which positions a row's key has used: a number in the mixed base of the choices made so far.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, keys, paths = (batch.column(i).to_numpy() for i in range(3))
        out = []
        for path in np.unique(paths):
            own = paths == path
            values = fps[own].view(np.uint64)
            choices = [int(path)] if level == 1 else [int(path) // 5, int(path) % 5] if level == 2 else [int(path) // 100, int(path) // 20 % 5, int(path) % 20]
            free = [p for p in range(8) if p not in TRIPLES[choices[0]]]
            if level == 1:
                taken = [(values >> np.uint64(8 * p)) & np.uint64(255) for p in free]
            else:
                free = [p for p in free if p != free[choices[1]]]
                nibbles = [(values >> np.uint64(8 * p + 4 * h)) & np.uint64(15) for p in free for h in (0, 1)]
                if level == 2:
                    taken = [nibbles[a] << np.uint64(8) | nibbles[b] << np.uint64(4) | nibbles[c] for a, b, c in TRIPLES]
                else:
                    taken = [nibbles[p] for p in range(8) if p not in TRIPLES[choices[2]]]
            out += [(fps[own], keys[own], np.full(own.sum(), path * len(taken) + k, np.int32), v.view(np.int64)) for k, v in enumerate(taken)]
        columns = [pa.array(np.concatenate(x)) for x in zip(*out)] if out else [pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["fp", "key", "path", "value"])

    rows = by_batch(hot.select("a", "b", "path"), run, "fp long, key long, path int, value long")
    return rows.select("fp", F.xxhash64("key", "path", "value").alias("key"), "path")


def links(distinct: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints ``fp`` that join all within ``MOST_BITS`` of each other.

    Of a long posting list only a tree of links is returned, never all pairs; it connects the same fingerprints.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    postings = F.posexplode(F.array(*(
        F.shiftleft(byte(a), 16).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)).bitwiseOR(F.lit(t << 24)) for t, (a, b, c) in enumerate(TRIPLES)
    ))).alias("path", "key")
    found = written(_compare(distinct.select("fp", postings), limit))
    total = found.where("path IS NULL")
    for level in (1, 2, 3):
        hot = found.where("path IS NOT NULL")
        if hot.isEmpty():
            break
        found = written(_compare(_dealt_anew(hot, level), limit if level < 3 else 1 << 20))
        total = total.union(found.where("path IS NULL"))
    return total.select("a", "b").distinct()


def _grouped(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``text_key`` and ``fp`` of each row; by ``fp`` the ``first`` row of its component, as (no id, doc_id, text_key)."""
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), utf8().alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = pa.array([fingerprint(t) for t in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "text_key", "fp"])

    fps = written(by_batch(keyed, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    distinct = fps.groupBy("fp").agg(first.alias("first"))
    roots = components(links(distinct.select("fp"), limit)).withColumnRenamed("node", "fp")
    rooted = written(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    return fps, rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")


def near_duplicates(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest ``doc_id`` reachable over links) of each row.

    Null and wordless texts have fingerprint 0 and are linked like any other equal ones. A component whose ids are all null has a
    null id. Repeated rows stay, other columns go.
    """
    fps, named = _grouped(docs, limit)
    return fps.join(named, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; rows without an id come last, then by text hash.

    Rows that repeat id and text count once.
    """
    _, named = _grouped(docs, limit)
    chosen = named.select(F.col("first.doc_id").alias("runlens_id"), F.col("first.text_key").alias("runlens_key")).distinct()
    keyed = docs.withColumn("runlens_text", F.xxhash64(text_of()))
    kept = keyed.join(chosen, (F.col("runlens_text") == F.col("runlens_key")) & F.col("doc_id").eqNullSafe(F.col("runlens_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "runlens_text"]).drop("runlens_text")


def digests(docs: DataFrame) -> DataFrame:
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
