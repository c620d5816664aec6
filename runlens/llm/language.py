"""Language of a text by piece unigrams summed over all segmentations.

The pieces are a fixed public vocabulary. Each language gives every piece a probability, learned by expectation-maximisation on
labelled words, and the probability of a word is the sum over all ways to cut it into pieces, which a forward pass finds. Words
are runs of letters in lower case with the mark of a word's beginning; a text's log-probability is the sum over its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.texts import bounded_batches, by_batch, only, remembers, text_of
from runlens.session import written

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: About so many labelled documents of each language are learned from (all, if there are fewer).
TRAIN_DOCS = 2500
#: Passes of expectation-maximisation, what each piece counts beforehand, and the scale that keeps products within range.
PASSES, SMOOTHING, SCALE = 2, 0.02, 1024.0
#: Different words whose counts a task gathers before it hands them on.
MOST_WORDS = 300_000
#: Labels that are learned, the commonest ones: labels misspelt in their thousands make no table of their own.
MOST_LANGUAGES = 400
#: Documents with a lower score are rejected by ``known_language``. The best of a few languages nearly always has more, so with the
#: usual labels only texts without letters go; a higher value rejects short texts that several languages share.
LEAST_SCORE = 0.3
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTERS_ALONE = regex.compile(r"\p{L}+")
_RENEW = 32
#: Words that are summed at a time, characters of the longest of them, and words whose sums a worker remembers.
TOGETHER, LONGEST_TOGETHER, MOST_SUMS = 4096, 48, 250_000
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@cache
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Number of each piece of letters (the byte pieces for other characters), and how many there are."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    numbers = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    numbers |= {f"\x00{int(model.id_to_piece(i)[3:5], 16)}": i for i in range(size) if model.is_byte(i)}
    return numbers, size


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Fractions, circled and raised digits are no letters, though they count as word characters."""
    found = _LETTERS.findall(text.lower())
    return [x for w in found for x in ([w] if w.isalpha() else _LETTERS_ALONE.findall(w))]


class Pieces:
    """Forward and backward sums over the segmentations of a word. ``table[piece]``: probability in each language."""

    def __init__(self, path: str, table: np.ndarray):
        numbers, _ = vocabulary(path)
        self.numbers, self.longest = numbers, max(map(len, numbers))
        lengths = np.ones(len(table))
        for piece, i in numbers.items():
            lengths[i] = 1 if piece[0] == "\x00" else len(piece)
        self.table = (table * SCALE ** lengths[:, None]).tolist()
        self.width = table.shape[1]
        self.memo: dict[str, bytes] = {}
        # Pieces by the hash of their characters; a bit field tells most other character runs apart before the search.
        plain = sorted((self._hash(p), i) for p, i in numbers.items() if p[0] != "\x00")
        self.hashes = np.array([h for h, _ in plain], np.uint64)
        self.rows = np.concatenate([np.array([table[i] * SCALE ** lengths[i] for _, i in plain]), np.zeros((1, self.width))])
        self.field = np.zeros(1 << 22, bool)
        self.field[self.hashes * _SPREAD >> np.uint64(42)] = True
        self.single = {p for p in numbers if len(p) == 1}

    @staticmethod
    def _hash(text: str) -> int:
        value = 0
        for c in reversed(text):
            value = (ord(c) + value * int(_BASE)) & ((1 << 64) - 1)
        return value

    def logs_of(self, words: list[str]) -> None:
        """Remembers the sums of words, those of like length together; others one by one."""
        short = sorted((w for w in words if len(w) < LONGEST_TOGETHER and self.single.issuperset(w)), key=len)
        memo = self.memo
        for w in set(words).difference(short):
            memo[w] = self.logs(w)
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            sizes = np.array([len(w) + 1 for w in part])
            most = int(sizes[-1])
            # Padding is no character, so no piece reaches into it.
            codes = np.frombuffer("".join(["\u2581" + w + "\x01" * (most - 1 - len(w)) for w in part]).encode("utf-32-le"), np.uint32)
            codes = codes.reshape(len(part), most).astype(np.uint64)
            sums = np.zeros((most + 1, len(part), self.width))
            sums[0] = 1.0
            found, runs = [], np.zeros((len(part), most + 1), np.uint64)
            for size in range(1, min(self.longest, most) + 1):
                runs = codes[:, : most - size + 1] + _BASE * runs[:, 1 : most - size + 2]
                known = self.field[runs * _SPREAD >> np.uint64(42)]
                place = np.full(runs.shape, len(self.hashes))
                asked = runs[known]
                near = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
                place[known] = np.where(self.hashes[near] == asked, near, len(self.hashes))
                found.append(place)
            for end in range(1, most + 1):
                for size in range(1, min(self.longest, end) + 1):
                    sums[end] += sums[end - size] * self.rows[found[size - 1][:, end - size]]
            logs = np.log(sums[sizes, np.arange(len(part))]) - (sizes * math.log(SCALE))[:, None]
            data, width = logs.tobytes(), 8 * self.width
            memo.update((w, data[k * width : (k + 1) * width]) for k, w in enumerate(part))

    def steps(self, word: str) -> list[list[tuple[int, list[int]]]]:
        """For each end the pieces that reach it: their beginnings and numbers. A character without a piece is spelled in bytes."""
        numbers, found = self.numbers, []
        for end in range(1, len(word) + 1):
            own = []
            for begin in range(max(0, end - self.longest), end):
                i = numbers.get(word[begin:end])
                if i is not None:
                    own.append((begin, [i]))
            if word[end - 1] not in numbers:
                own.append((end - 1, [numbers[f"\x00{b}"] for b in word[end - 1].encode()]))
            found.append(own)
        return found

    def _chance(self, ids: list[int]) -> list[float]:
        if len(ids) == 1:
            return self.table[ids[0]]
        # Of the scale, a character spelled in bytes keeps one factor.
        return [math.prod(x) / SCALE ** (len(ids) - 1) for x in zip(*(self.table[i] for i in ids))]

    def logs(self, word: str) -> bytes:
        """Log-probability of a word in each language, as the bytes of doubles."""
        marked = "▁" + word
        sums, added, table, numbers, longest = [[1.0] * self.width], np.zeros(self.width), self.table, self.numbers, self.longest
        for end in range(1, len(marked) + 1):
            total = [0.0] * self.width
            for begin in range(max(0, end - longest), end):
                i = numbers.get(marked[begin:end])
                if i is not None:
                    total = [t + a * p for t, a, p in zip(total, sums[begin], table[i])]
            if marked[end - 1] not in numbers:
                spelled = self._chance([numbers[f"\x00{b}"] for b in marked[end - 1].encode()])
                total = [t + a * p for t, a, p in zip(total, sums[end - 1], spelled)]
            sums.append(total)
            if end % _RENEW == 0:
                added += np.log(total)
                for k in range(max(0, end - longest), end + 1):
                    sums[k] = [s / t for s, t in zip(sums[k], total)]
        return (np.log(sums[-1]) + added - len(marked) * math.log(SCALE)).tobytes()

    def expected(self, word: str, language: int, weight: float, counts: np.ndarray) -> None:
        """Adds how often each piece is expected in the segmentations of a word. Each place's sums are scaled to one."""
        marked = "▁" + word
        steps, size = self.steps(marked), len(marked)
        table = self.table
        chances = [[(b, ids, math.prod(table[i][language] for i in ids) / SCALE ** (len(ids) - 1)) for b, ids in own] for own in steps]
        forward, logs = [1.0], [0.0]
        for own in chances:  # forward[k] is the sum at k over exp(logs[k])
            high = max(logs[b] for b, _, _ in own)
            total = sum(forward[b] * math.exp(logs[b] - high) * p for b, _, p in own)
            forward.append(1.0)
            logs.append(high + math.log(total))
        backward = [0.0] * size + [1.0]
        for end in range(size, 0, -1):
            for b, ids, p in chances[end - 1]:
                share = forward[b] * math.exp(logs[b] - logs[end]) * p * backward[end]
                backward[b] += share
                for i in ids:
                    counts[language, i] += weight * share


def held_out() -> Column:
    """Rows that nothing is learned from: the CRC-32 of the id as text leaves 1 when divided by 3 (null: the empty text's)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _word_counts(docs: DataFrame, languages: dict[str, int]) -> DataFrame:
    """``language`` (number), ``word`` and ``n`` of labelled documents."""
    bounded_batches(docs.sparkSession)
    owner = __name__

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        counts: Counter = Counter()

        def told():
            rows = [(k, w, n) for (k, w), n in counts.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()))], ["language", "word", "n"])

        for part in parts:
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                number = languages[label]
                counts.update((number, w) for w in words_of(text))
                if len(counts) > MOST_WORDS:
                    yield told()
        yield told()

    rows = docs.select("text", "lang").mapInArrow(run, "language int, word string, n long")
    return rows.groupBy("language", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece in each of them (pieces by languages).

    Learns from the texts of rows with a language that are not held out, and of the ``MOST_LANGUAGES`` commonest labels; no rows, no
    languages. Memory grows with the vocabulary times the languages only.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    commonest = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    seen = {r["lang"]: r["n"] for r in commonest.collect()}
    names = sorted(seen)
    if not names:
        return [], np.empty((vocabulary(path)[1], 0))
    shares = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, train_docs / seen[name]))))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.try_element_at(shares, F.col("lang")))
    words = written(_word_counts(sample, {name: k for k, name in enumerate(names)}))
    size = vocabulary(path)[1]
    table = np.full((size, len(names)), 1.0 / size)
    for _ in range(PASSES):
        sent = docs.sparkSession.sparkContext.broadcast(table)

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, counts = Pieces(path, sent.value), np.zeros(sent.value.T.shape)
            for part in parts:
                for language, word, n in zip(*(part.column(i).to_pylist() for i in range(3))):
                    own.expected(word, language, n, counts)
            at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])], ["language", "piece", "n"])

        sums = words.mapInArrow(run, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        counts = np.full((size, len(names)), SMOOTHING)
        for row in sums.collect():  # at most one row for each piece and language
            counts[row["piece"], row["language"]] += row["n"]
        table = counts / counts.sum(axis=0)
    return names, table


def _judge(own: Pieces | None, names: list[str], texts: list[str | None]) -> list[tuple[str, float]]:
    if own is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    rows, memo = [words_of(t) if t else [] for t in texts], own.memo
    new = {w for words in rows for w in words if w not in memo}
    if len(memo) + len(new) > MOST_SUMS:
        memo.clear()
        new = {w for words in rows for w in words}
    own.logs_of(list(new))
    out = []
    for words in rows:
        if not words:
            out.append((UNKNOWN, 0.0))
            continue
        logs = np.frombuffer(b"".join([memo[w] for w in words])).reshape(-1, len(names)).sum(axis=0)
        best = int(logs.argmax())
        out.append((names[best], float(1 / np.exp(logs - logs[best]).sum())))
    return out


_MODELS: dict[str, Pieces] = {}
remembers(__name__, _MODELS.clear)


def _model(path: str, sent, number: str) -> Pieces:
    """One set of sums for each model in a worker, the last one only."""
    if number not in _MODELS:
        _MODELS.clear()
        _MODELS[number] = Pieces(path, sent.value)
    return _MODELS[number]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (its share of the probability) of each row; only the text is looked at.

    A text that is null or has no letter is ``und`` with score 0, as is any where no language was learned. Of languages with equal sums
    the first by name is taken.
    """
    names, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)
    number = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _model(path, sent, number) if names else None
        found = _judge(own, names, batch.column(1).to_pylist())
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = LEAST_SCORE, path: str = VOCABULARY) -> DataFrame:
    """Rows, with all their columns, whose text has letters and whose language has a share of ``least``; where no row has a label, all rows."""
    names, table = learn(docs, path=path)
    if not names:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(table)
    number, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _model(path, sent, number)
        found = _judge(own, names, batch.column(at).to_pylist())
        yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return by_batch(docs, run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Predictions of all rows by a model learned from those that are not held out."""
    predicted = predict(docs, learn(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
