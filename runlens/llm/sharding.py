"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``NODES`` places on the ring, and a row belongs to the first place clockwise of its hash. A shard holds its share of
the rows and no more - shares differ by one at most - so rows that find it full continue clockwise. Rows between two places are alike
for the ring, so where how many of them go is settled on the counts of these arcs (a table of fixed size); a row's rank in
its arc then gives its shard and slot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.texts import size_bytes, text_of, utf8
from runlens.session import written

SHARDS, NODES = 24, 128
#: Rows of a cell, the part of an arc that one task ranks, on average.
CELL_ROWS = 20_000
#: Equal rows that one task writes out at a time.
COPIES = 100_000


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """Places (signed 64-bit position, shard) in order. A shard's places do not depend on how many others there are."""
    return sorted((xxhash.xxh64_intdigest(f"{s}:{k}") - (1 << 63), s) for s in range(shards) for k in range(nodes))


def _clockwise(places: list[tuple[int, int]], at: int) -> Iterator[int]:
    """Different shards from a place on."""
    seen = set()
    for k in range(len(places)):
        shard = places[(at + k) % len(places)][1]
        if shard not in seen:
            seen.add(shard)
            yield shard


def settle(places: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[dict]:
    """Which ranks of each arc go to which slots of which shard. First all rows ask at their own place, then those left at the next."""
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    left, asked, used, segments = dict(counts), {arc: _clockwise(places, arc) for arc in counts}, [0] * shards, []
    while any(left.values()):
        for arc in sorted(a for a, n in left.items() if n):
            shard = next(asked[arc])
            taken = min(left[arc], free[shard])
            if taken:
                first = counts[arc] - left[arc]
                segments.append({"arc": arc, "first": first, "stop": first + taken, "shard": shard, "slot": used[shard]})
                left[arc] -= taken
                free[shard] -= taken
                used[shard] += taken
    return segments


def assign(rows: DataFrame, key: str, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows, by the hash in column ``key``; equal rows are counted first and written out at the end.

    Other columns named ``arc``, ``cell``, ``copies``, ``first``, ``stop`` are not allowed.
    """
    spark, names, places = rows.sparkSession, rows.columns, ring(shards, nodes)
    points = F.array(*(F.lit(p) for p, _ in places))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(places).bit_length()))))
    before = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) < F.col(key), at + step).otherwise(at))
    counted = rows.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("arc", before % len(places))
    stored = written(counted)
    counts = {r["arc"]: r["n"] for r in stored.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    if not counts:
        return rows.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cells = max(1, max(counts.values()) // CELL_ROWS)
    celled = stored.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), key), F.lit(cells)))
    sums = celled.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("arc", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("arc", "cell").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = celled.withColumn("rank", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(bases, ["arc", "cell"])
    # At most one segment for each arc and shard.
    text = F.lit(json.dumps(settle(places, counts, shards)))
    kind = "array<struct<arc:int,first:long,stop:long,shard:int,slot:long>>"
    segments = spark.range(1).select(F.inline(F.from_json(text, kind)))
    rank = F.col("base") + F.col("rank")
    parts = ranked.join(F.broadcast(segments), "arc").where((rank < F.col("stop")) & (rank + F.col("copies") > F.col("first"))).select(
        *names, "shard", (F.col("slot") + F.greatest(rank, "first") - F.col("first")).alias("low"),
        (F.col("slot") + F.least(rank + F.col("copies"), "stop") - F.col("first")).alias("high"),
    )
    blocks = parts.select(*names, "shard", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(COPIES))).alias("low"))
    return blocks.repartition("shard", "low").select(
        *names, "shard", F.explode(F.sequence("low", F.least("high", F.col("low") + COPIES) - 1)).alias("slot"),
    )


def shards(docs: DataFrame, count: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """``doc_id``, ``size`` (bytes and 8), ``text_crc32``, ``shard`` and ``slot`` of each row. The hash is of id and text, so that rows
    without an id spread as well; a null text is an empty one. Repeated rows fill neighbouring slots."""
    rows = docs.select(
        "doc_id", (size_bytes() + 8).alias("size"), F.crc32(utf8()).alias("text_crc32"), F.xxhash64("doc_id", text_of()).alias("ring_key"),
    )
    return assign(rows, "ring_key", count, nodes).drop("ring_key")


def digests(docs: DataFrame) -> DataFrame:
    """Shards under the law ``rows``: counts of two shards differ by one at most."""
    return shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
