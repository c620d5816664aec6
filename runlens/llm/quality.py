"""Quality rules of texts, judged for documents and for their hosts.

Each rule fails or passes a document. By host the failures of a rule are counted and the rate is shrunk towards all hosts: a beta
prior, fitted to the hosts' rates by their first two moments, keeps a host of three documents from being condemned for one. A host
whose shrunk rate of any rule passes ``HOST_LIMIT`` takes all its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.texts import by_batch, utf8
from runlens.session import written

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 50
#: Per cent of a text's words.
MOST_REPEATED, MOST_SYMBOLS, MOST_DUPLICATE_LINES = 50, 50, 30
HOST_LIMIT = 0.5
#: What the prior weighs at least and at most, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    keys = ids[:n]
    for k in range(1, size):
        keys = keys * len(number) + ids[k : k + n]
        if len(number) > 1 << 20:  # renumbered, so that no product overflows
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    marked = np.isin(keys, twice)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= marked
    return int(covered.sum())


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the counts of each text; a null text has none. Repeated rows stay, other columns go."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in batch.column(2).to_pylist():
            words, text = data.split(), data.decode()
            lines = [x for x in data.split(b"\n") if x.strip()]
            rows.append((
                len(words), len(text) - sum(map(text.count, SPACES)), sum(map(data.count, SYMBOLS)), len(lines) - len(set(lines)),
                repeated_words(words),
            ))
        counts = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts.T)], ["doc_id", "source", *MEASURES])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), utf8().alias("text"))
    fields = ", ".join(f"{m} long" for m in MEASURES)
    return by_batch(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, {fields}")


def rules() -> dict[str, Column]:
    """Whether a document fails each rule."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * words,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * words,
        "lines": 100 * F.col("n_dup_lines") > MOST_DUPLICATE_LINES * words,
    }


def base_failed() -> Column:
    return rules()["short"] | rules()["repeats"]


def host_rates(measured: DataFrame) -> DataFrame:
    """``source``, ``rule``, documents, failures and the shrunk ``rate``. Rows without a source belong to no host."""
    counts = measured.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count("*").alias("n"), *(F.count_if(failed).alias(name) for name, failed in rules().items()),
    )
    names = list(rules())
    long = counts.select("source", "n", F.stack(F.lit(len(names)), *(x for name in names for x in (F.lit(name), F.col(name)))).alias("rule", "failed"))
    share = F.col("failed") / F.col("n")
    mean, spread = F.sum("failed") / F.sum("n"), F.var_samp(share)
    # Of the spread between hosts, what their sizes alone would cause is taken off first.
    noise = F.avg(F.lit(1) / F.col("n")) * mean * (1 - mean)
    weight = F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), mean * (1 - mean) / (spread - noise) - 1))
    # A prior for each rule: as many rows as there are rules.
    priors = long.groupBy("rule").agg(mean.alias("mean"), F.when(spread > noise, weight).otherwise(PRIOR_WEIGHT[1]).alias("weight"))
    rate = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return long.join(F.broadcast(priors), "rule").select("source", "rule", "n", "failed", rate.alias("rate"))


def verdicts(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each row: kept unless a base rule fails or its host is condemned."""
    measured = written(measures(docs))
    # Written, so that the join below can be split where a host has very many documents, or be a broadcast where hosts are few.
    hosts = written(host_rates(measured).groupBy("source").agg((F.max("rate") > limit).alias("condemned")))
    joined = measured.join(hosts, "source", "left")
    return joined.select(
        "doc_id", *MEASURES, base_failed().alias("base_failed"),
        (~base_failed() & ~F.coalesce("condemned", F.lit(False))).alias("kept"),
    )


ORACLE = rf"""
WITH parts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM parts)
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS seen FROM grams) WHERE seen > 1)
  GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM parts LEFT JOIN repeated USING (doc_id)
), failed AS (
  SELECT *, n_words < {MIN_WORDS} AS short, 100 * n_repeat_words > {MOST_REPEATED} * n_words AS repeats,
    100 * n_symbols > {MOST_SYMBOLS} * n_words AS symbols, 100 * n_dup_lines > {MOST_DUPLICATE_LINES} * n_words AS dup_lines FROM measured
), hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS k
  FROM (UNPIVOT (SELECT source, short, repeats, symbols, dup_lines FROM failed WHERE source IS NOT NULL) ON short, repeats, symbols, dup_lines INTO NAME rule VALUE bad)
  GROUP BY source, rule
), moments AS (
  SELECT rule, sum(k) / sum(n) AS mean, var_samp(k / n) AS spread, avg(1 / n) AS size FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, mean, CASE WHEN spread > size * mean * (1 - mean)
    THEN greatest({PRIOR_WEIGHT[0]}, least({PRIOR_WEIGHT[1]}, mean * (1 - mean) / (spread - size * mean * (1 - mean)) - 1)) ELSE {PRIOR_WEIGHT[1]} END AS weight
  FROM moments
), condemned AS (
  SELECT source, max((k + mean * weight) / (n + weight)) > {HOST_LIMIT} AS bad FROM hosts JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT coalesce(bad, FALSE) AS kept FROM failed LEFT JOIN condemned USING (source)
"""
