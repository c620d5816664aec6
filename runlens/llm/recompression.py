"""Removal of repeated passages by recompression.

Rounds of pairing shrink the word sequence: a rule of the symbol's name alone puts it on the left or on the right side, and every left
symbol followed by a right one becomes one new symbol, named by its two parts. Names are a function of content, the same in all
tasks, so equal passages get equal symbols in their interior. Each symbol carries its context, the words that decide that it
exists. A window of words therefore holds the same symbols wherever it stands, as far as their contexts lie inside, and the first
such symbol of the highest round is its anchor. A window of one repeated word has the run of that word for its anchor.

Spark gathers the anchors by name: those that occur once reveal nothing, the others mark the windows that may repeat. The
windows so marked are then compared by content (two independent 64-bit hashes of their words), and in the order of the documents all
but the first of equal ones are removed. Before each shuffle a batch of documents keeps one of equal rows only, as the others are
already decided; so a passage in a third of all documents sends a few rows instead of millions.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.texts import Memo, bounded_batches, only, remembers, text_of
from runlens.session import written

WINDOW, ROUNDS = 20, 6
#: Words that are hashed and parsed at a time.
MOST_WORDS = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit number scrambled, so that any bit of it may decide."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any range of a word sequence in constant time: a polynomial over the word hashes, modulo 2^64."""

    def __init__(self, words: np.ndarray):
        powers = np.full(len(words), _ODD)
        inverse = np.full(len(words) + 1, _INVERSE)
        if len(words):
            powers[0] = 1
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers))])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


_WORDS = Memo(lambda w: xxhash.xxh64_intdigest(w).to_bytes(8, "little"))
remembers(__name__, _WORDS.clear)


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join([_WORDS[w] for words in texts for w in words]), np.uint64)


def rounds(words: np.ndarray, first: np.ndarray, last: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names and contexts (begin, end) of the symbols of each round. ``first``, ``last``: the ends of each word's document.

    What a document's border decides has a context beyond it, which no window holds.
    """
    name, begin, end = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    low, high = first, last
    found = [(name, begin, end)]
    for k in range(1, count + 1):
        left = mixed(name + np.uint64(k)) >> np.uint64(63) == 1
        joint = low[1:] == low[:-1]
        pair = left[:-1] & ~left[1:] & joint
        opens, closes = np.append(pair, False), np.insert(pair, 0, False)
        alone = ~(opens | closes)
        # A left symbol stays because of what follows it, a right one because of what stands before it.
        after = np.where(np.append(joint, False), np.append(end[1:], 0), high + 1)
        before = np.where(np.insert(joint, 0, False), np.insert(begin[:-1], 0, 0), low - 1)
        new_end = np.where(alone & left, after, end)
        new_begin = np.where(alone & ~left, before, begin)
        new_end[:-1][pair] = end[1:][pair]
        named = name.copy()
        named[:-1][pair] = mixed(name[:-1][pair] * _ODD + mixed(name[1:][pair] + np.uint64(k)))
        keep = ~closes
        name, begin, end, low, high = named[keep], new_begin[keep], new_end[keep], low[keep], high[keep]
        found.append((name, begin, end))
    return found


def anchors(words: np.ndarray, sizes: np.ndarray, window: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (anchor name, first window, number of windows, whether all of them are equal) for documents of ``sizes`` words, given
    one after another. Windows are counted by their first word over all documents. Neighbouring windows of one anchor share a row.
    """
    stops = np.cumsum(sizes)
    first, last = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
    at = np.flatnonzero(np.arange(len(words)) + window <= last)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    name, place = np.zeros(len(words), np.uint64), np.full(len(words), -1, np.int64)
    # Runs of one word, as long as a window.
    changes = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (first[1:] != first[:-1])]))
    run_end = np.repeat(np.append(changes[1:], len(words)), np.diff(np.append(changes, len(words))))
    run = at[run_end[at] >= at + window]
    name[run] = mixed(words[run] ^ _ODD)
    place[run] = run_end[run]
    at = at[run_end[at] < at + window]
    ranges = Hashes(words)
    for k, (names, begin, end) in reversed(list(enumerate(rounds(words, first, last, count)))):
        j = np.searchsorted(begin, at)
        j[j == len(begin)] = len(begin) - 1
        inside = (begin[j] >= at) & (end[j] <= at + window)
        j, own = j[inside], at[inside]
        name[own] = mixed(names[j] + ranges.of(begin[j], end[j]) + np.uint64(k))
        place[own] = begin[j]
        at = at[~inside]
    chosen = np.flatnonzero(place >= 0)
    same = (name[chosen][1:] == name[chosen][:-1]) & (place[chosen][1:] == place[chosen][:-1]) & (np.diff(chosen) == 1) & (first[chosen][1:] == first[chosen][:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    number = np.diff(np.append(heads, len(chosen)))
    return name[chosen][heads], chosen[heads], number, (run_end[chosen][heads] >= chosen[heads] + window) & (number > 1)


def _split(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``MOST_WORDS`` words; a longer document is a range of its own."""
    begin, total = 0, 0
    for k, words in enumerate(texts):
        if total and total + len(words) > MOST_WORDS:
            yield begin, k
            begin, total = k, 0
        total += len(words)
    if begin < len(texts):
        yield begin, len(texts)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their keys, and which of them in that order begin a group of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


#: A document is its id and the hash of its text; ``id`` is the largest number for rows without one.
_NO_ID = (1 << 63) - 1
_ANCHORS = "name long, id long, text_key long, low int, n int, known boolean"
_WINDOWS = "one long, two long, id long, text_key long, low int, n int"


@contextmanager
def _cleared_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go once it is over: the next job starts from the table it has written. Then all is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with_own(docs: DataFrame) -> DataFrame:
    """Adds ``runlens_own``, a number in the order of the ids. Whole numbers are taken as they are; ids of another type are sorted in
    ranges, where the number of a row's range and its place in it make one growing number."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return docs.withColumn("runlens_own", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    ids = docs.select(F.col("doc_id").alias("runlens_doc")).where("runlens_doc IS NOT NULL").distinct()
    number = F.monotonically_increasing_id().alias("runlens_number")
    ids = written(ids.repartitionByRange("runlens_doc").sortWithinPartitions("runlens_doc").select("runlens_doc", number))
    joined = docs.join(ids, F.col("doc_id") == F.col("runlens_doc"), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce("runlens_number", F.lit(_NO_ID)).alias("runlens_own"))


def _keyed(docs: DataFrame) -> DataFrame:
    own = docs if "runlens_own" in docs.columns else _with_own(docs)
    return own.select(F.col("runlens_own").alias("id"), F.xxhash64(text_of()).alias("text_key"), text_of().cast("binary").alias("text"))


def shared_anchors(docs: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """``id``, ``text_key``, ``low`` and ``n`` of windows whose anchors occur more than once."""

    owner = __name__

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.split() for t in batch.column(2).to_pylist()]
            for begin, end in _split(texts):
                sizes = np.array([len(w) for w in texts[begin:end]])
                name, low, n, alike = anchors(word_hashes(texts[begin:end]), sizes, window, count)
                starts = np.cumsum(sizes) - sizes
                doc = np.searchsorted(np.cumsum(sizes), low, side="right")
                order, new = _firsts(name)
                several = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
                # One row of each name asks the others; where a batch has it several times, all of its windows are marked.
                known = np.empty(len(name), bool)
                known[order] = np.repeat(several, np.diff(np.append(np.flatnonzero(new), len(new))))
                known |= alike
                asks = np.zeros(len(name), bool)
                asks[order[new]] = True
                # A marked row that does not ask is spread by its own place; n < 0 keeps the two apart.
                spread = mixed(keys[begin + doc].view(np.uint64) + low.astype(np.uint64))
                sent = np.where(asks, name, spread)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent.view(np.int64)), pa.array(ids[begin + doc]), pa.array(keys[begin + doc]), pa.array((low - starts[doc]).astype(np.int32)),
                     pa.array(np.where(asks, n, -n).astype(np.int32)), pa.array(known)],
                    ["name", "id", "text_key", "low", "n", "known"],
                )

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the name so far, if it waits for another one
        for batch in batches:
            name, n, known = batch.column(0).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            if not len(name):
                continue
            plain = n > 0
            rows = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
            asking = np.flatnonzero(plain)
            equal = name[asking][1:] == name[asking][:-1]
            shared = known.copy()
            shared[asking] |= np.append(equal, False) | np.insert(equal, 0, False) if len(asking) else False
            if held is not None and len(asking):
                if held[0] == name[asking[0]]:
                    shared[asking[0]] = True
                    if not held[1]:
                        yield held[2].select(["id", "text_key", "low", "n"])
            if len(asking):
                last = int(asking[-1])
                held = (name[last], bool(shared[last]), rows.slice(last, 1))
            out = rows.filter(pa.array(shared)).select(["id", "text_key", "low", "n"])
            yield out.set_column(3, "n", pa.array(np.abs(out.column(3).to_numpy()).astype(np.int32)))

    spark = docs.sparkSession
    bounded_batches(spark)
    named = _keyed(docs).mapInArrow(parse, _ANCHORS)
    # Rows that ask come first in no order but by name; the others only pass through.
    return named.repartition("name").sortWithinPartitions("name").mapInArrow(share, "id long, text_key long, low int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """``id``, ``text_key``, ``low`` and ``n`` of windows that stand earlier as well: in a smaller id, or before in the same document."""
    spark = docs.sparkSession
    with _cleared_shuffles(spark):
        marked = written(shared_anchors(docs, window, count))
    # A set, as a row that is repeated brings its marks again.
    by_doc = marked.groupBy("id", "text_key").agg(F.collect_set(F.struct("low", "n")).alias("marks"))

    owner = __name__

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, marks = [t.split() for t in batch.column(2).to_pylist()], batch.column(3)
            ends, flat = marks.offsets.to_numpy(), marks.flatten()
            lows, ns = (x.to_numpy() for x in flat.flatten())
            ends = ends - ends[0]
            for begin, end in _split(texts):
                sizes = np.array([len(w) for w in texts[begin:end]])
                words, starts = word_hashes(texts[begin:end]), np.cumsum(sizes) - sizes
                own = slice(ends[begin], ends[end])
                doc = np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1]))
                low, n = starts[doc] + lows[own], ns[own].astype(np.int64)
                at = np.unique(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                doc = np.searchsorted(starts + sizes, at, side="right")
                one = Hashes(words).of(at, at + window).view(np.int64)
                two = Hashes(mixed(words ^ _ODD)).of(at, at + window).view(np.int64)
                order, new = _firsts(one, two, ids[begin + doc], keys[begin + doc], at)
                head = np.zeros(len(order), bool)
                if len(order):
                    head[0] = True
                    head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                kept, gone = order[head], np.sort(order[~head])
                # Later ones of a batch are decided; ranges of them are spread by their own place.
                joined = (np.diff(gone) == 1) & (doc[gone][1:] == doc[gone][:-1]) & (np.diff(at[gone]) == 1)
                first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(gone) else np.empty(0, int)
                runs = np.diff(np.append(first, len(gone)))
                gone = gone[first]
                row = np.concatenate([kept, gone])
                spread = mixed(keys[begin + doc[row]].view(np.uint64) + at[row].astype(np.uint64)).view(np.int64)
                sent = np.concatenate([one[kept], spread[len(kept):]])
                number = np.concatenate([np.zeros(len(kept), np.int32), runs.astype(np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent), pa.array(two[row]), pa.array(ids[begin + doc[row]]), pa.array(keys[begin + doc[row]]),
                     pa.array((at[row] - starts[doc[row]]).astype(np.int32)), pa.array(number)],
                    ["one", "two", "id", "text_key", "low", "n"],
                )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            one, two, n = (batch.column(c).to_numpy() for c in ("one", "two", "n"))
            asks = np.flatnonzero(n == 0)
            later = n > 0
            if len(asks):
                again = (one[asks][1:] == one[asks][:-1]) & (two[asks][1:] == two[asks][:-1])
                later[asks[1:]] = again
                later[asks[0]] = last == (one[asks[0]], two[asks[0]])
                last = (one[asks[-1]], two[asks[-1]])
            out = batch.filter(pa.array(later)).select(["id", "text_key", "low", "n"])
            yield out.set_column(3, "n", pa.array(np.maximum(out.column(3).to_numpy(), 1).astype(np.int32)))

    bounded_batches(spark)
    # Rows that repeat id and text are one document.
    marked_docs = _keyed(docs).join(by_doc, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("id", "text_key", "text", "marks")
    windows = marked_docs.mapInArrow(compare, _WINDOWS)
    return windows.repartition("one").sortWithinPartitions("one", "two", "id", "text_key", "low").mapInArrow(
        decide, "id long, text_key long, low int, n int")


def _covered(size: int, marks: list[dict], window: int) -> np.ndarray:
    """Which words of a text lie in one of the marked windows."""
    steps = np.zeros(size + 1, np.int64)
    for mark in marks:
        steps[mark["low"]] += 1
        steps[mark["low"] + mark["n"] - 1 + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """A text without the words that are gone. White space before a kept word stays, that before a removed one goes with it."""
    parts, at, done = [], 0, 0
    for word, removed in zip(text.split(), gone.tolist()):
        at = text.index(word, at)
        stop = at + len(word)
        if not removed:
            parts.append(text[done:stop] if parts else text[at:stop])
        at = done = stop
    return b"".join(parts)


def _marks(docs: DataFrame, window: int, count: int) -> DataFrame:
    windows = repeated_windows(docs, window, count)
    with _cleared_shuffles(docs.sparkSession):
        found = written(windows)
    return found.groupBy(F.col("id").alias("runlens_id"), F.col("text_key").alias("runlens_key")).agg(F.collect_list(F.struct("low", "n")).alias("runlens_marks"))


def _marked(docs: DataFrame, window: int, count: int) -> DataFrame:
    """All rows with the windows to be removed, null where there are none."""
    own = _with_own(docs)
    marks = _marks(own, window, count)
    joined = own.withColumn("runlens_text", F.xxhash64(text_of())).join(
        marks, (F.col("runlens_own") == F.col("runlens_id")) & (F.col("runlens_text") == F.col("runlens_key")), "left")
    return joined.select(*(own[c] for c in docs.columns), "runlens_marks")


def kept_words(docs: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (remaining words, joined by one space) of each row.

    Windows are judged on the input. A null text has no words. Rows that repeat an id with the same text are one document and
    have the same result; with another text they follow each other by the hash of their texts, and rows without an id come last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                gone = _covered(len(words), marks, window) if marks else None
                total.append(len(words))
                removed.append(int(gone.sum()) if marks else 0)
                kept.append((b" ".join(words) if gone is None else b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).decode())
            columns = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    rows = _marked(docs.select("doc_id", "text"), window, count).select("doc_id", text_of().cast("binary").alias("text"), "runlens_marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, count: int = ROUNDS) -> DataFrame:
    """All rows with all their columns; repeated passages are cut out of ``text`` and, where text was cut, ``n_chars`` is counted anew."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, counts = columns[at].to_pylist(), columns[chars].to_pylist() if chars is not None else []
            for k, marks in enumerate(batch.columns[-1].to_pylist()):
                if marks:
                    data = texts[k].encode()
                    texts[k] = cut(data, _covered(len(data.split()), marks, window)).decode()
                    if chars is not None:
                        counts[k] = len(texts[k])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return _marked(docs, window, count).mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    rows = kept_words(docs)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i,
    unnest(list_transform(generate_series(1, len(words)), lambda k: CASE WHEN k + {WINDOW - 1} <= len(words) THEN array_to_string(words[k : k + {WINDOW - 1}], ' ') END)) AS passage
  FROM parts
), seen AS (
  SELECT doc_id, word, i, CAST(passage IS NOT NULL AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS INTEGER) AS later FROM placed
), marked AS (
  SELECT doc_id, word, i, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM seen
), kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS rest FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM parts LEFT JOIN kept USING (doc_id)
"""
