"""Personal data: plain rules first, then identifiers of unseen form that are found by their contexts.

Spans of the plain rules are seeds. The words around a seed make lexical patterns. An instance that a pattern may point at is every
token with a digit or an at sign, and every stretch of text that has the look of a kind. Patterns and instances form a graph that Spark scores in turns: a pattern is worth the share
of its instances that are known, an instance what its patterns together make likely. Patterns of many seeds and high worth then
mark instances that look like their kind but follow no rule, such as a phone number without its prefix.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.texts import by_batch, text_of
from runlens.session import written

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring, different seeds a pattern needs, what a pattern's score and an instance's must reach, and what counts against a pattern.
TURNS, LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE, DOUBT = 3, 4, 0.7, 0.7, 1.0
#: Characters up to which neighbouring tokens count as one, a context word is told from others, and an instance stands for itself in the graph.
LONGEST = 40
#: Characters of the longest instance: a mail address has 254 at most. Of the other looks the longest is a phone number of 15 digits with two
#: characters between any two and one before.
LONGEST_MAIL, LONGEST_NUMBER = 254, 44

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From a later digit of a run the rule fails where it fails from the first, so it is tried at first digits only.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SHOWN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?: [^\s0-9@]*[0-9@]\S*)*")
_NEAR = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]<>"
_OUTER = ".,;:!?\"'[]<>"
_AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_AFTER = re.compile(r"[ ]?[^\s@]+")
_DIGIT = re.compile(r"[0-9]")
_LOOKS = (
    re.compile(r"[^\s@]+(?:@|[ ]?[(\[]at[)\]][ ]?)[^\s@]+"),
    re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z]{1,3}[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ ./-]?[0-9]){11,18}"),
    re.compile(r"[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}"),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain rules, in order; ends are exclusive, places are code points."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _word(text: str) -> str:
    found = _NEAR.search(text)
    return _context(found.group()) if found else ""


def _context(word: str) -> str:
    """A context word. All of more than ``LONGEST`` characters are one word, which differs from the border of a text."""
    return word.strip(_EDGE).lower() if len(word) <= LONGEST else "=long"


def _named(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> str:
    """A part of a text with the names of kinds in place of spans, as contexts of one identifier hardly recur."""
    parts, done = [], start
    for a, kind, b in spans[max(0, bisect_left(spans, (start,)) - 1) :]:
        if a >= end:
            break
        if b > done and b > start:
            parts += [text[done:a], f" ={KINDS[kind]} "]
            done = b
    return "".join([*parts, text[done:end]])


def patterns(text: str, start: int, end: int, spans: list[tuple[int, int, int]] = ()) -> list[str]:
    """Two words before a span; one before and one after it. Empty words stand for the borders of the text."""
    before = _named(text, max(0, start - 3 * LONGEST), start, spans).split()[-2:]
    left = [_context(w) for w in before]
    left = [""] * (2 - len(left)) + left
    # What directly touches the span belongs to it, as in a quoted number.
    right = _word(_named(text, end + len(text[end : end + 3]) - len(text[end : end + 3].lstrip(_EDGE)), end + 3 * LONGEST, spans))
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right}"]


def looks(shown: str) -> list[int]:
    """Kinds whose look a text has, by its full form."""
    return [k for k, look in enumerate(_LOOKS) if look.fullmatch(shown.lower())]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _OUTER:
        a += 1
    while a < b and text[b - 1] in _OUTER:
        b -= 1
    return a, b


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans with overlapping ones put together; the first names the kind."""
    out = []
    for a, kind, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], b))
        else:
            out.append((a, kind, b))
    return out


def _free(a: int, b: int, stops: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of a part of a text without the spans in it."""
    out = []
    for s, _, e in stops[max(0, bisect_left(stops, (a,)) - 1) :]:
        if s >= b:
            break
        if e > a:
            if s > a:
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, b)] if a < b else out


def _stretches(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts that start with the token at ``start``, end with one before ``end``, and have the look of a number."""
    for m in _NEAR.finditer(text, start, min(end, start + LONGEST_NUMBER + 8)):
        # A token that the limit cuts off is no token; letters stand in no number.
        if m.end() < end and not text[m.end()].isspace() or any(map(str.isalpha, m.group())):
            return
        a, b = _trimmed(text, start, m.end())
        if b - a > LONGEST_NUMBER:
            return
        if any(look.fullmatch(text, a, b) for look in _LOOKS[1:]):
            yield a, b


def _written_out(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses whose at sign is written out."""
    for m in _AT.finditer(text):
        low = max(0, m.start() - LONGEST_MAIL)
        before = max(low, m.start() - 1) if text[low : m.start()].endswith(" ") else m.start()
        start = before
        while start > low and text[start - 1] != "@" and not text[start - 1].isspace():
            start -= 1
        after = _AFTER.match(text, m.end(), m.end() + LONGEST_MAIL)
        if start < before and after:
            a, b = _trimmed(text, start, after.end())
            a, b = a + (text[a] == "("), b - (text[b - 1] == ")" and b > m.end() + 1)
            if a < m.start() and b > m.end() and b - a <= LONGEST_MAIL:
                yield a, b


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind, instance, digits, looks, patterns) of the spans and of what else may be an identifier.

    Kind -1: tokens that hold a digit or an at sign, neighbours together, and addresses with a written-out at sign. Kind -2: other
    stretches that have a look; they may be marked, but do not count against a pattern, as most overlap one that does.
    """
    places, stops = {}, _disjoint(spans)
    for m in _SHOWN.finditer(text):
        for low, high in _free(m.start(), m.end(), stops):
            # Neighbouring tokens are one instance, unless they are too long together.
            parts = [(low, high)] if high - low <= LONGEST else [p.span() for p in _NEAR.finditer(text, low, high)]
            for start, stop in parts:
                while start < stop and text[start].isspace():
                    start += 1
                while start < stop and text[stop - 1].isspace():
                    stop -= 1
                a, b = _trimmed(text, start, stop)
                whole = (start == 0 or text[start - 1].isspace()) and (stop == len(text) or text[stop].isspace())
                if a < b <= a + LONGEST_MAIL and (whole or any(c in "0123456789@" for c in text[a:b])):
                    places[a, b] = max(places.get((a, b), -2), -1 if whole else -2)
            for token in _NEAR.finditer(text, low, high):
                first = _trimmed(text, *token.span())[0]
                if first < token.end() and text[first] in "0123456789(":
                    after = bisect_left(stops, (first,))
                    for place in _stretches(text, first, stops[after][0] if after < len(stops) else len(text)):
                        places.setdefault(place, -2)
    for a, b in _written_out(text):
        if _free(a, b, stops) == [(a, b)]:
            places[a, b] = -1
    found = [(a, b, kind) for a, kind, b in spans if b - a <= LONGEST_MAIL] + [(*place, kind) for place, kind in places.items()]
    return [
        (a, b, kind, _instance(text[a:b].lower()), len(_DIGIT.findall(text, a, b)), [] if kind >= 0 else looks(text[a:b]), patterns(text, a, b, stops))
        for a, b, kind in found
    ]


def _instance(shown: str) -> str:
    """What an instance is called in the graph; a long one by its hash."""
    return shown if len(shown) <= LONGEST else f"#{xxhash.xxh3_128_hexdigest(shown.encode('utf-8', 'surrogatepass'))}"


_SCANNED = (
    "base array<struct<start:int,kind:int,end:int>>, "
    "mentions array<struct<start:int,end:int,kind:int,instance:string,digits:int,looks:array<int>,patterns:array<string>>>"
)
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MENTIONS = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("digits", pa.int32()), ("looks", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string())),
]))
#: A row is known again by its id and the hash of its text; rows equal in both have equal spans.
_KEY = ("doc_id", "text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, spans of the plain rules and mentions of each row; a null text is an empty one."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base = [base_spans(t) for t in batch.column(2).to_pylist()]
        found = [mentions(t, s) for t, s in zip(batch.column(2).to_pylist(), base)]
        columns = [
            pa.array([[dict(zip(("start", "kind", "end"), x)) for x in row] for row in base], _BASE),
            pa.array([[dict(zip(("start", "end", "kind", "instance", "digits", "looks", "patterns"), x)) for x in row] for row in found], _MENTIONS),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "base", "mentions"])

    return by_batch(_keyed(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, {_SCANNED}")


def learn(scanned: DataFrame) -> DataFrame:
    """``pattern``, ``kind``, ``score`` and mean ``digits`` of seeds of the patterns that may mark instances.

    The graph holds each different pattern and instance pair once. Counts are aggregated before every shuffle.
    """
    shown = scanned.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", "m.digits", "m.looks", F.explode("m.patterns").alias("pattern"))
    # A pattern needs seeds, so edges of others fall away at once.
    edges = shown.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("digits").alias("digits"), F.max("looks").alias("looks"))
    totals = edges.groupBy("pattern").agg(
        F.count_if(F.col("kind") >= -1).alias("n"), F.count_if(F.col("kind") >= 0).alias("seeds")).where(f"seeds >= {LEAST_SEEDS}")
    graph = written(edges.join(totals.select("pattern", "n"), "pattern"))
    known = graph.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("worth")).distinct()
    asked = graph.where("kind < 0").select("pattern", "instance", F.explode("looks").alias("kind"))
    usual = graph.where("kind >= 0").groupBy("pattern", "kind").agg(F.avg("digits").alias("digits"))
    scores = None
    for turn in range(TURNS):
        worth = graph.select("pattern", "instance", "n", (F.col("kind") < -1).alias("besides")).join(known, "instance")
        scores = worth.groupBy("pattern", "kind").agg(
            (F.sum("worth") / (F.first("n") + F.count_if("besides") + DOUBT)).alias("score"), F.count_if(F.col("worth") == 1.0).alias("seeds"),
        ).where((F.col("seeds") >= LEAST_SEEDS) & (F.col("score") >= LEAST_PATTERN)).select("pattern", "kind", "score")
        scores = written(scores)
        if turn + 1 < TURNS:
            # Of two independent patterns either may be right.
            told = asked.join(scores, ["pattern", "kind"]).groupBy("instance", "kind").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("worth"))
            seeds = graph.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("worth")).distinct()
            known = written(seeds.union(told.where(F.col("worth") >= LEAST_INSTANCE).select("instance", "kind", F.least("worth", F.lit(0.99)))))
    return scores.join(usual, ["pattern", "kind"])


def discovered(scanned: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and the added spans, of those that overlap the likeliest.

    Where they are equally likely, the number of digits nearest to that of the seeds decides, then the smaller one: a country's own
    form of a number leaves out its prefix.
    """
    asked = scanned.select(*_KEY, F.explode("mentions").alias("m")).where("m.kind < 0").select(
        *_KEY, "m.start", "m.end", F.col("m.digits").alias("own"), F.explode("m.looks").alias("kind"), "m.patterns")
    asked = asked.select(*_KEY, "start", "end", "own", "kind", F.explode("patterns").alias("pattern"))
    worth = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
    hits = asked.join(scores, ["pattern", "kind"]).groupBy(*_KEY, "start", "end", "kind", "own").agg(
        worth.alias("worth"), F.min(F.abs(F.col("own") - F.col("digits"))).alias("off")).where(F.col("worth") >= LEAST_INSTANCE)
    order = F.struct((-F.col("worth")).alias("less"), F.when(F.col("kind") == 0, 0.0).otherwise(F.col("off")).alias("off"), "own", "kind", "start", "end")
    listed = hits.groupBy(*_KEY).agg(F.array_sort(F.collect_set(order)).alias("hits"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        added = []
        for hits in batch.column(2).to_pylist():
            taken = []
            for x in hits:
                at = bisect_left(taken, (x["end"],))  # the first that starts at or after the end
                if at == 0 or taken[at - 1][2] <= x["start"]:
                    taken.insert(at, (x["start"], x["kind"], x["end"]))
            added.append([dict(zip(("start", "kind", "end"), t)) for t in taken])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, _BASE)], [*_KEY, "added"])

    name = scanned.schema["doc_id"].dataType.simpleString()
    return by_batch(listed, run, f"doc_id {name}, text_key long, added array<struct<start:int,kind:int,end:int>>")


def _matched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the array ``added``, null where nothing was added."""
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "added")
    return rows.join(found, (F.col("text_key") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("found_id")), "left")


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (base and added ones) of each row, each an array of (start, kind, end) in order."""
    scanned = written(scan(docs))
    found = written(discovered(scanned, learn(scanned)))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return _matched(scanned.select(*_KEY, "base"), found).select("doc_id", "base", every.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows with all their columns; in the text each span is replaced by its kind in brackets. Null texts stay null."""
    scanned = written(scan(docs))
    found = written(discovered(scanned, learn(scanned)))
    key, added = "runlens_text_key", "runlens_added"
    found = found.select(F.col("doc_id").alias("runlens_id"), F.col("text_key").alias("runlens_found"), F.col("added").alias(added))
    joined = docs.withColumn(key, F.xxhash64(text_of())).join(
        found, (F.col(key) == F.col("runlens_found")) & F.col("doc_id").eqNullSafe(F.col("runlens_id")), "left")
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for text, more in zip(batch.column(at).to_pylist(), batch.column(len(batch.schema) - 1).to_pylist()):
            if text is not None:
                text = masked(text, base_spans(text) + [(x["start"], x["kind"], x["end"]) for x in more or []])
            texts.append(text)
        columns = [batch.column(i) for i in range(len(batch.schema) - 1)]
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return by_batch(joined.select(*(docs[c] for c in docs.columns), added), run, docs.schema)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """A text with spans replaced; of overlapping spans the first names the kind of them all."""
    parts, done = [], 0
    for a, kind, b in sorted(found):
        if a >= done:
            parts += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def _joined(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the spans of the plain rules, and all spans."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
