"""Packing with a mixture: every window takes tokens of each source in proportion to its target.

Each source is a queue of tokens, its documents one after another through all tasks. Deficit round-robin serves the queues in
rounds, one for each window: a round adds the source's share of a window to its deficit, and the source hands over as many whole
portions as its deficit holds; what is left of the deficit goes on to the next round. As a queue's deficit depends on the number of
rounds alone, a round is known by its number: any task finds the deficits that all windows before it left, in its own partition or
another, without going through them. The portions in the order of rounds and sources are one stream of tokens, which is cut into
sequences; the rest at its end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.byte_tokens import RANKS, VOCABULARY, byte_ids
from runlens.llm.texts import bounded_batches, text_of
from runlens.session import written

CAPACITY, END_ID = 1024, 0
#: Tokens of the portions in which a source is served: shorter ones follow a target more closely and cut documents more often.
PORTION = 64
#: Queues with a deficit of their own; the sources with fewest tokens share one.
MOST_QUEUES = 64


@dataclass(frozen=True)
class Schedule:
    """Deficit round-robin over queues of ``sizes`` tokens that get ``quanta`` tokens a round."""

    sizes: np.ndarray
    quanta: np.ndarray
    portion: int = PORTION
    capacity: int = CAPACITY

    def last(self) -> np.ndarray:
        """Rounds after which a queue is empty, whatever is left of its deficit."""
        return np.ceil(self.sizes / self.quanta).astype(np.int64)

    def served(self, queue, rounds: np.ndarray) -> np.ndarray:
        """Tokens that ``rounds`` rounds take from a queue."""
        whole = np.floor(self.quanta[queue] * rounds / self.portion).astype(np.int64) * self.portion
        return np.where(rounds >= self.last()[queue], self.sizes[queue], np.minimum(whole, self.sizes[queue]))

    def deficits(self, rounds: int) -> np.ndarray:
        """What the queues carry over into the window after ``rounds`` rounds."""
        at = np.full(len(self.sizes), rounds)
        return np.where(at >= self.last(), 0.0, self.quanta * rounds - self.served(np.arange(len(self.sizes)), at))

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round that takes a token, given by its place in the queue."""
        found = np.ceil((token // self.portion + 1) * self.portion / self.quanta[queue]).astype(np.int64) - 1
        found = np.clip(found, 0, self.last()[queue] - 1)
        for _ in range(3):  # the quotient may be rounded to either side
            found = np.where(self.served(queue, found + 1) <= token, found + 1, found)
        for _ in range(3):
            found = np.where((found > 0) & (self.served(queue, found) > token), found - 1, found)
        return found

    def stream_place(self, queue: np.ndarray, token: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Place of a token, which a known round takes, in the stream."""
        place = token - self.served(queue, rounds)
        for other in range(len(self.sizes)):
            place = place + np.where(other < queue, self.served(other, rounds + 1), self.served(other, rounds))
        return place

    def borders(self) -> tuple[int, np.ndarray]:
        """Number of whole sequences, and where the sequences of powers of two behind them end."""
        total = int(self.sizes.sum())
        full, rest = divmod(total, self.capacity)
        parts = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        return full, full * self.capacity + np.cumsum(parts, dtype=np.int64)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``source``, ``ids`` (two or four bytes each), their number ``n``, and the task with the tokens of the source before in it."""
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, before = byte_ids(vocabulary, ranks), TaskContext.get().partitionId(), {}
        for batch in parts:
            sizes, earlier, ids = [], [], []
            for text, source in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                found = np.append(own.encode(text), np.uint32(end_id))
                ids.append(found.astype(np.uint16).tobytes() if found.max() < 1 << 16 else found.tobytes())
                sizes.append(len(found))
                earlier.append(before.get(source, 0))
                before[source] = earlier[-1] + len(found)
            columns = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array([task] * len(sizes), pa.int32()), pa.array(earlier, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "source", "ids", "n", "task", "before"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _source(docs).alias("source"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, ids binary, n long, task int, before long")


def _source(docs: DataFrame) -> Column:
    """Rows without a source, and tables without sources, are one source without a name."""
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def schedule(sizes: Mapping[str, int], targets: Mapping[str, float] | None = None, portion: int = PORTION, capacity: int = CAPACITY) -> Schedule:
    """The rounds of queues by their tokens. Without targets each queue gets its share of all tokens, so that all end together.

    Targets are relative: queues that are named divide among them what they have of all tokens, the others keep their own shares.
    """
    number = np.array(list(sizes.values()), np.int64)
    shares = number / max(1, number.sum())
    if targets is not None:
        known = {k: v for k, v in targets.items() if v > 0 and k in sizes}
        given = sum(share for name, share in zip(sizes, shares) if name in known) / max(1e-300, sum(known.values()))
        shares = np.array([known[name] * given if name in known else share for name, share in zip(sizes, shares)])
    return Schedule(number, shares / shares.sum() * capacity if len(shares) else shares, portion, capacity)


def place(table: DataFrame, targets: Mapping[str, float] | None = None, portion: int = PORTION, capacity: int = CAPACITY, most: int = MOST_QUEUES) -> DataFrame:
    """Pieces of a stored table of ``encoded`` rows, with their places."""
    spark = table.sparkSession
    by_task = written(table.groupBy("source", "task").agg(F.sum("n").alias("n")))
    ranked = by_task.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source")
    named = {r["source"]: int(r["n"]) for r in ranked.limit(most).collect()}
    rest = int(by_task.agg(F.sum("n")).first()[0] or 0) - sum(named.values())
    names = {name: k for k, name in enumerate(sorted(named))}
    plan = schedule({**{name: named[name] for name in names}, **({None: rest} if rest else {})}, targets, portion, capacity)
    numbers = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,int>")
    queue = F.coalesce(F.try_element_at(numbers, F.col("source")), F.lit(len(names)))
    earlier = Window.partitionBy("queue", "block").orderBy("source", "task").rowsBetween(Window.unboundedPreceding, -1)
    # Tasks in blocks, so that the places of no queue are added up in one task.
    numbered = by_task.withColumn("queue", queue).withColumn("block", F.floor(F.xxhash64("source", "task") % 1024))
    blocks = numbered.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    ahead = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = numbered.withColumn("within", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    firsts = within.join(ahead.drop("n"), ["queue", "block"]).select("source", "task", "queue", (F.col("ahead") + F.col("within")).alias("first"))
    rows = table.join(firsts, ["source", "task"]).select("doc_id", "source", "ids", "n", "queue", (F.col("first") + F.col("before")).alias("first"))
    full, ends = plan.borders()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            n, queue, first = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            row, begin, end, at = _pieces(plan, queue, first, n)
            sequence = np.where(at < full * capacity, at // capacity, full + np.searchsorted(ends, at, side="right"))
            border = np.concatenate([[full * capacity], ends])
            start = np.where(sequence < full, sequence * capacity, border[np.maximum(0, np.minimum(sequence - full, len(border) - 1))])
            ids = batch.column(2).to_pylist()
            crc, low, high = [], (begin - first[row]).tolist(), (end - first[row]).tolist()
            held, last = None, -1
            for r, a, b in zip(row.tolist(), low, high):
                if r != last:
                    held, last = np.frombuffer(ids[r], np.uint16 if len(ids[r]) == 2 * n[r] else np.uint32).astype("<u4"), r
                crc.append(zlib.crc32(held[a:b]))
            taken = pa.array(row)
            columns = [
                batch.column(0).take(taken), pa.array(low, pa.int64()), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(n[row]),
                pa.array(sequence), pa.array(at - start), batch.column(1).take(taken),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def _pieces(plan: Schedule, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end in the queue, and place in the stream, of the pieces into which rounds and sequences cut rows."""
    low, high = plan.round_of(queue, first), plan.round_of(queue, first + n - 1)
    count = high - low + 1
    row = np.repeat(np.arange(len(n)), count)
    rounds = low[row] + np.arange(count.sum()) - (np.cumsum(count) - count)[row]
    own = queue[row]
    begin, end = np.maximum(first[row], plan.served(own, rounds)), np.minimum((first + n)[row], plan.served(own, rounds + 1))
    some = end > begin
    row, rounds, own, begin, end = (x[some] for x in (row, rounds, own, begin, end))
    at = plan.stream_place(own, begin, rounds)
    # What neighbouring rounds take of one document stays together where nothing else comes between.
    joined = np.zeros(len(row), bool)
    joined[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + end[:-1] - begin[:-1])
    heads = np.flatnonzero(~joined)
    row, begin, at, end = row[heads], begin[heads], at[heads], end[np.append(heads[1:], len(row)) - 1]
    full, ends = plan.borders()
    edge = full * plan.capacity
    # Sequence borders inside a piece: multiples of the capacity, then the powers of two.
    stop = at + end - begin
    inner = np.maximum(0, (np.minimum(stop, edge) - 1) // plan.capacity - at // plan.capacity) * (at < edge)
    cut_row = np.repeat(np.arange(len(row)), inner)
    cuts = (at // plan.capacity)[cut_row] + 1 + np.arange(inner.sum()) - (np.cumsum(inner) - inner)[cut_row]
    more = [(np.flatnonzero((at < x) & (x < stop)), x) for x in [edge, *ends.tolist()]]
    cut_row = np.concatenate([cut_row, *(r for r, _ in more)])
    cuts = np.concatenate([cuts * plan.capacity, *(np.full(len(r), x) for r, x in more)])
    part, places = np.concatenate([np.arange(len(row)), cut_row]), np.concatenate([at, cuts])
    order = np.lexsort((places, part))
    part, places = part[order], places[order]
    keep = np.ones(len(part), bool)
    keep[1:] = (part[1:] != part[:-1]) | (places[1:] != places[:-1])
    part, places = part[keep], places[keep]
    head = np.ones(len(part), bool)
    head[1:] = part[1:] != part[:-1]
    until = np.where(np.append(head[1:], True), stop[part], np.append(places[1:], 0))
    start = begin[part] + places - at[part]
    return row[part], start, start + until - places, places


def pack(docs: DataFrame, targets: Mapping[str, float] | None = None, portion: int = PORTION, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows with their places and sources.

    A null or empty text is its end id alone; a text of any length is cut where windows need it, and each id is in one piece. Rows that
    repeat id and text are documents of their own. Queues follow tasks, and within a task its rows. Columns beyond ``doc_id``, ``text``
    and ``source`` are not looked at. An empty table gives no pieces. Ends of queues may come at different windows where ``targets``
    differ from what there is; the other queues then fill the windows. No window lacks more than a portion of what a source is due.
    """
    return place(written(encoded(docs, end_id=end_id)), targets, portion, capacity)
