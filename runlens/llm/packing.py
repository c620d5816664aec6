"""Packing of tokenised documents into sequences of one length, by a configuration linear program.

A configuration is a multiset of piece lengths that fits into a sequence. The program - fewest configurations that hold each length
as often as the histogram says - has far too many columns to list, so its dual prices are found by multiplicative weights: each
round prices the lengths, a knapsack dynamic program gives the best configuration around each length, and prices fall where a
round covers more than its share and rise elsewhere. Each phase rounds the fractional solution down and starts anew on what is
left; a last remainder goes to the best-fitting open sequences, whole groups of equal ones at a time. All this works on the
histogram, which has at most ``capacity`` entries however many rows there are; rows meet their places by length and rank.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm.texts import Memo, bounded_batches, only, remembers, utf8
from runlens.llm.word_tokens import TOKENIZER, MergedIds
from runlens.session import written

CAPACITY = 4096
END_ID = 1
#: Weight rounds in a phase, phases, and how far from the best a configuration may be to count as an answer of its round.
ROUNDS, PHASES, SLACK = 6, 4, 0.005

Configuration = tuple[tuple[int, ...], int]


class WordIds:
    """Ids of texts: by compiled ranks where these know all characters, otherwise word by word, as no token of this tokenizer
    crosses ASCII white space.

    Words are remembered, and below them their cores - without last stops and, in ASCII, in lower case - as most new words are
    new only in these. Both memories have a bound.
    """

    def __init__(self, path: str, most_words: int = 700_000, most_cores: int = 1_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.merged = MergedIds(self.tokenizer) if path == TOKENIZER else None
        encode = self.tokenizer.encode
        self.cores = Memo(lambda c: array("I", encode(c.decode(), add_special_tokens=False).ids).tobytes(), most_cores)
        self.words = Memo(self._word, most_words)

    @staticmethod
    def core(word: bytes) -> tuple[bytes, bytes]:
        """Core and stops. Stops are tokens of their own after an ASCII letter or digit; after others they may join it."""
        if b"<|" in word:  # may hold a special token, which is read as it is written
            return word, b""
        core = word.rstrip(b".,;:!?")
        if core[-1:].isalnum():
            return (core.lower() if core.isascii() else core), word[len(core) :]
        return word, b""

    def _word(self, word: bytes) -> bytes:
        core, stops = self.core(word)
        return self.cores[core] + self.cores[stops] if stops else self.cores[core]

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes the new cores of many texts that are letters alone, which the tokenizer keeps apart at spaces, some hundreds at a time."""
        known, cores = self.words, self.cores
        split = {w: self.core(w) for w in set().union(*texts) if w not in known and len(w) <= known.longest}
        new = [c for c in {c for c, _ in split.values()} if c not in cores and self._letters(c)]
        if len(cores) + len(new) > cores.most:
            cores.clear()
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            found = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            data, begin = array("I", found.ids).tobytes(), 0
            ends = 4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part)), side="right")
            for core, end in zip(part, ends.tolist()):
                cores[core] = data[begin:end]
                begin = end
        if len(known) + len(split) > known.most:
            known.clear()
        known.update((w, cores[c] + cores[s] if s else cores[c]) for w, (c, s) in split.items())

    @staticmethod
    def _letters(core: bytes) -> bool:
        """Whether a core is one run of Latin letters. The one letter whose lower case is two characters does not count."""
        text = core.decode()
        return text.isalpha() and (core.isascii() or (max(text) < "\u0250" and "\u0130" not in text))

    def encode(self, words: list[bytes]) -> bytes:
        """Little-endian 32-bit ids of the words of a text."""
        known = self.words
        return b"".join([known[w] for w in words])

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        plain = [self.merged is not None and self.merged.knows(t) for t in texts]
        merged = iter(self.merged.encode([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        others = [t.split() for t, p in zip(texts, plain) if not p]
        self.learn(others)
        rest = map(self.encode, others)
        return [next(merged if p else rest) for p in plain]


@cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


remembers(__name__, _word_ids.cache_clear)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of each row: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (unsigned 32-bit numbers), and the task and
    the rank among equal lengths of that task. A null text is an empty one, which has the end id alone. Repeated rows stay."""
    bounded_batches(docs.sparkSession)
    end, owner = array("I", [end_id]).tobytes(), __name__

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        words, task, seen = _word_ids(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in parts:
            rows, number, lengths, ranks, ids = [], [], [], [], []
            for row, text in enumerate(words.texts(batch.column(1).to_pylist())):
                data = text + end
                for at in range(0, len(data), 4 * capacity):
                    own = data[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append(row)
                    number.append(at // (4 * capacity))
                    lengths.append(size)
                    ranks.append(seen[size])
                    ids.append(own)
                    seen[size] += 1
            starts = pa.array(np.array(number, np.int64) * capacity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), starts, pa.array(lengths, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([task] * len(rows), pa.int32()), pa.array(ranks, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids", "task", "task_rank"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, task int, task_rank long"
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, schema)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room, and the index of a length that begins it (-1: leave one token empty)."""
    value, first = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        n = fitting[room]
        if n:
            tried = value[room - lengths[:n]] + prices[:n]
            best = tried.argmax()
            if tried[best] > value[room]:
                value[room], first[room] = tried[best], best
    return value, first


def _answers(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each length the best configuration that holds it, as indexes; only those whose value is near the best of all."""
    value, first = _knapsack(lengths, prices, capacity)
    best, found = value[capacity], []
    for i in np.flatnonzero(prices + value[capacity - lengths] >= (1 - SLACK) * best):
        room, taken = capacity - int(lengths[i]), [int(i)]
        while room > 0:
            k = int(first[room])
            if k < 0:
                room -= 1
            else:
                taken.append(k)
                room -= int(lengths[k])
        found.append(tuple(sorted(taken)))
    return list(dict.fromkeys(found))


def _weights(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Fractional multiplicities of configurations by multiplicative weights; the first prices are the lengths themselves."""
    prices, total = lengths / capacity, Counter()
    share = (lengths * counts).sum() / capacity / ROUNDS
    for _ in range(ROUNDS):
        answers = _answers(lengths, prices, capacity)
        # Each answer is played in proportion to the rarest demand it meets, the round as a whole by its share.
        plays = np.array([min(counts[i] / n for i, n in Counter(a).items()) for a in answers])
        plays *= share / plays.sum()
        covered = np.zeros(len(lengths))
        for a, x in zip(answers, plays):
            total[a] += x
            for i in a:
                covered[i] += x
        prices = prices * np.exp(-0.5 * np.clip(ROUNDS * covered / counts - 1, -1, 2) / ROUNDS)
    return total


def _best_fit(left: dict[int, int], capacity: int) -> list[Configuration]:
    """Long pieces first, each to the fullest open sequence that has room; equal sequences move together."""
    open_: dict[int, list[Configuration]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in sorted(left, reverse=True):
        count = left[length]
        moved: list[tuple[int, Configuration]] = []
        while count:
            fit = int(rooms[length:].argmax()) + length
            if fit > capacity or not rooms[fit]:
                # New sequences, each filled with as many of these pieces as it holds.
                each = capacity // length
                if count >= each:
                    moved.append((capacity - each * length, ((length,) * each, count // each)))
                    count %= each
                if count:
                    moved.append((capacity - count * length, ((length,) * count, 1)))
                break
            content, number = open_[fit].pop()
            if not open_[fit]:
                rooms[fit] = False
            each = min(fit // length, max(1, count // number))
            used = min(number, count // each)
            if used < number:
                open_[fit].append((content, number - used))
                rooms[fit] = True
            count -= used * each
            rest = fit - each * length
            if rest >= length and count:
                open_.setdefault(rest, []).append((content + (length,) * each, used))
                rooms[rest] = True
            else:
                moved.append((rest, (content + (length,) * each, used)))
        for room, group in moved:
            open_.setdefault(room, []).append(group)
            rooms[room] = True
    return [group for groups in open_.values() for group in groups]


def _rounded(left: dict[int, int], capacity: int, up: bool) -> list[Configuration]:
    used: list[Configuration] = []
    for _ in range(PHASES):
        if len(left) < 2:
            break
        lengths = np.array(sorted(left))
        counts = np.array([left[int(s)] for s in lengths])
        plays, before = _weights(lengths, counts, capacity), counts.sum()
        for a, x in sorted(plays.items(), key=lambda p: (-p[1], p[0])):
            needs = Counter(a)
            whole = min(int(np.ceil(x) if up else x), *(int(counts[i]) // n for i, n in needs.items()))
            if whole > 0:
                used.append((tuple(int(lengths[i]) for i in a), whole))
                for i, n in needs.items():
                    counts[i] -= whole * n
        left = {int(s): int(n) for s, n in zip(lengths, counts) if n}
        if counts.sum() > 0.8 * before:
            break
    return used + _best_fit(left, capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Configuration]:
    """Configurations (tuples of lengths) and how often each is used, holding each length exactly as often as it occurs.

    The fractional solution is rounded down and, where lengths are rare and most parts are below one, up; the fewer sequences count.
    """
    left = {int(s): int(n) for s, n in histogram.items() if n}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    full: list[Configuration] = [((capacity,), left.pop(capacity))] if capacity in left else []
    plans = [_rounded(left, capacity, up) for up in (False, True)]
    return full + min(plans, key=lambda plan: sum(number for _, number in plan))


def _runs(plan: list[Configuration]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of each length from a first one on, the sequence of that first rank, and the offset in the sequence; sorted by key."""
    taken, rows, base = Counter(), [], 0
    for content, number in plan:
        offset = 0
        for length in content:
            rows.append((length << 44 | taken[length], base, offset))
            taken[length] += number
            offset += length
        base += number
    keys, sequences, offsets = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.empty(0, np.int64),) * 3
    return keys, sequences, offsets


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of ``length``, ``task`` and ``task_rank``."""
    spark = table.sparkSession
    by_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, sequences, offsets = (spark.sparkContext.broadcast(x) for x in _runs(solve(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = table.join(firsts, ["length", "task"])
    kept = [c for c in table.columns if c not in ("task", "task_rank")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            own = batch.column("key").to_numpy()
            at = np.searchsorted(keys.value, own, side="right") - 1
            columns = [batch.column(c) for c in kept] + [pa.array(sequences.value[at] + own - keys.value[at]), pa.array(offsets.value[at])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    key = F.shiftleft("length", 44).bitwiseOR(F.col("before") + F.col("task_rank")).alias("key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*kept).schema)
    return ranked.select(*kept, key).mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, keep_ids: bool = False, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows with their places. The token ids themselves are kept on request; their CRC-32 always is."""
    table = pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place(written(table if keep_ids else table.drop("ids")), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` of each sequence, from pieces packed with their ids; a sequence has at most ``capacity``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
