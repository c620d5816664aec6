"""One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Near fingerprints (``simhash``) and bands of least hashes propose pairs and the sets themselves decide. Two sets of similarity ``s`` share a band of three with
probability ``s**3``, so a pair at exactly 0.8 escapes all twenty bands with probability 0.488**20, less than one in a million.

No list is cut and none makes a square of pairs. All sets of a list are compared with its leaders first; what these join needs no
more comparing. Of a short list the rest is compared pair by pair. The sets of long lists that are still apart meet in a second
index: their shingles in the order of how many of these sets have them, of which each set shows only its first fifth, as two sets
of similarity 0.8 cannot differ in all of these. A passage that many texts share stands last in that order, so it brings no texts
together that are not alike otherwise. Before sets are fetched, sixty hashes of four bits each tell most pairs apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import simhash
from runlens.llm.components import components
from runlens.llm.texts import by_batch, text_of, utf8
from runlens.session import written

SHINGLE, SEED, BANDS, ROWS, LEADERS = 5, 42, 20, 3, 3
#: Sets of a list that are compared pair by pair at once.
LIST_LIMIT = 16
#: Of the sixty hashes of a pair of similarity 0.8 about 11 differ, and more than this not once in a million pairs.
MOST_DIFFERENT = 26
SKETCH = ("s0", "s1", "s2", "s3")

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(data: bytes) -> np.ndarray:
    """Sorted different hashes of the runs of five words of a UTF-8 text, or of all its words where there are fewer."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    begins, stops = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(begins, stops)], np.uint64))


def _least(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, at : at + 1024] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys of the bands; an empty set has none."""
    return _keys(_least(hashes)) if len(hashes) else []


def _keys(least: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketch(least: np.ndarray) -> list[int]:
    """Four bits of each least hash, sixteen in a signed number."""
    bits = np.zeros(16 * len(SKETCH), np.uint64)
    bits[: len(least)] = least >> np.uint64(8) & np.uint64(15)
    return (bits.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``node`` (a 128-bit hash of the set), its size ``n``, ``bands``, ``sketch`` and fingerprint ``fp`` of each row."""
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), utf8().alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(2).to_pylist()
        sets = [shingles(t) for t in texts]
        least = [_least(s) for s in sets]
        columns = [
            pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array([_keys(x) if len(s) else [] for s, x in zip(sets, least)], pa.list_(pa.int64())),
            pa.array([_sketch(x) for x in least], pa.list_(pa.int64())),
            pa.array([simhash.fingerprint(t) for t in texts], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "node", "n", "bands", "sketch", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(keyed, run, f"doc_id {kind}, text_key long, node string, n int, bands array<long>, sketch array<long>, fp long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node`` and its ``hashes`` for nodes with the row ``first`` that shows them."""
    keyed = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64(text_of()).alias("own_key"), utf8().alias("text"))
    at = wanted.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    rows = keyed.join(at, (F.col("own_key") == F.col("text_key")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("node", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    # A row that repeats id and text shows its set again.
    return by_batch(rows, run, "node string, hashes array<long>").dropDuplicates(["node"])


def _may_be_alike(one: str, other: str) -> Column:
    """Sizes within four to five, and few enough different hashes, of two structs of ``n`` and the sketch."""
    different = F.lit(0)
    for name in SKETCH:
        bits = F.col(f"{one}.{name}").bitwiseXOR(F.col(f"{other}.{name}"))
        for shift in (1, 2):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        different = different + F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (different <= MOST_DIFFERENT)


def _pairs(found: DataFrame) -> DataFrame:
    """Different ``a``, ``b`` pairs of two ``node`` structs ``x`` and ``y``, the smaller node first."""
    x, y = F.col("x.node"), F.col("y.node")
    return found.where(x != y).where(_may_be_alike("x", "y")).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets are alike enough: nine times what is shared is four times both sizes at least."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("u")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("v")), "b")
    return written(both.where(9 * F.size(F.array_intersect("u", "v")) >= 4 * (F.size("u") + F.size("v"))).select("a", "b"))


def _rooted(nodes: DataFrame, links: DataFrame, own: str = "node") -> DataFrame:
    """``nodes`` with the smallest node, as ``root``, that ``links`` lead to from the one in the column ``own``."""
    found = components(links).select(F.col("node").alias("linked"), F.col("root").alias("linked_root"))
    kept = [c for c in nodes.columns if c != "root"]
    return nodes.join(found, F.col(own) == F.col("linked"), "left").select(*kept, F.coalesce("linked_root", own).alias("root"))


def _between_roots(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between nodes as links between the roots these have by now."""
    root = nodes.select("node", "root")
    return links.join(root.select(F.col("node").alias("a"), F.col("root").alias("p")), "a").join(
        root.select(F.col("node").alias("b"), F.col("root").alias("q")), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))


def _prefixes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """What each set shows of itself: ``token``, ``x`` (``node``, ``n``, sketch, ``root``, ``at``) and whether the smaller of two sets shows it too.

    Tokens are in the order of how many of the ``nodes`` have them; those of one set alone come first and are not listed. Of ``n``
    tokens a pair of similarity 0.8 shares one among the first ``n - ceil(4 n / 5) + 1`` of the larger set and the first
    ``n - ceil(8 n / 9) + 1`` of the smaller.
    """
    tokens = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("hashes").alias("token"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    # The tokens of one document meet here, not those of a group.
    ordered = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")).join(nodes, "node")
    alone, n = F.col("n") - F.size("shared"), F.col("n")
    shown = n - F.floor((4 * n + 4) / 5).cast("int") + 1
    rows = ordered.select(
        F.struct("node", "n", *SKETCH, "root").alias("x"), alone.alias("alone"), (n - F.floor((8 * n + 8) / 9).cast("int") + 1).alias("small"),
        F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), shown - alone))).alias("k", "s"))
    at = F.col("alone") + F.col("k")
    return rows.select(F.col("s.token").alias("token"), F.col("x").withField("at", at).alias("x"), (at < F.col("small")).alias("small"))


def _can_share(one: str = "x", other: str = "y") -> Column:
    """Whether enough tokens are left from a first shared one on."""
    left = [F.col(f"{s}.n") - F.col(f"{s}.at") for s in (one, other)]
    return 9 * F.least(*left) >= 4 * (F.col(f"{one}.n") + F.col(f"{other}.n"))


def _apart(sets: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Links between roots of all alike ``nodes`` (``node``, ``n``, sketch, ``root``) that are still apart."""
    entries = written(_prefixes(sets, nodes))
    # Who has the least of its own is likest to the others of its list.
    order = F.struct((F.col("x.at") / F.col("x.n")).alias("own"), F.col("x.node").alias("node"))
    lists = entries.groupBy("token").agg(F.count("*").alias("size"), F.min_by("x", order).alias("y"), F.min("x.root").alias("r"), F.max("x.root").alias("s"))
    leaders = lists.where(F.col("size") > limit).where("r != s").select("token", "y")
    stars = entries.join(leaders, "token").where("x.root != y.root").where(_can_share())
    links = _between_roots(_links(sets, _pairs(stars)), nodes)
    merged = _rooted(entries.select("token", "small", "x", F.col("x.root").alias("old")), links, "old").select(
        "token", "small", F.col("x").withField("root", F.col("root")).alias("x"))
    merged = written(merged)
    mixed = merged.groupBy("token").agg(F.min("x.root").alias("r"), F.max("x.root").alias("s")).where("r != s").select("token")
    open_ = merged.join(mixed, "token")
    other = open_.select(F.col("token").alias("same"), F.col("x").alias("y"))
    smaller = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    met = (F.col("token") == F.col("same")) & smaller & (F.col("x.root") != F.col("y.root")) & _can_share() & _may_be_alike("x", "y")
    pairs = open_.where("small").join(other, met).select("x", "y")
    return links.union(_between_roots(_links(sets, _pairs(pairs)), nodes))


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs of ``node`` structs ``x`` and ``y``: each with the least of its fingerprint, and those least ones of fingerprints that are linked."""
    least = written(nodes.groupBy("fp").agg(F.min("x").alias("y")))
    linked = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(
        least.select(F.col("fp").alias("b"), "y"), "b")
    return nodes.join(least, "fp").select("x", "y").union(linked.select("x", "y"))


def _alike(docs: DataFrame, distinct: DataFrame, limit: int) -> DataFrame:
    """Links that join all nodes whose sets are alike enough."""
    plain = distinct.select("node", "n", "bands", "fp", *(F.col("sketch")[k].alias(name) for k, name in enumerate(SKETCH)))
    postings = plain.select(F.struct("node", "n", *SKETCH).alias("x"), F.explode("bands").alias("key"))
    leaders = [F.min(F.struct(F.xxhash64("x.node", F.lit(k)).alias("by"), "x"))["x"] for k in range(LEADERS)]
    lists = postings.groupBy("key").agg(F.count("*").alias("size"), F.array(*leaders).alias("leaders")).where("size > 1")
    lists = lists.withColumn("leaders", F.when(F.col("size") > limit, F.col("leaders")).otherwise(F.slice("leaders", 1, 1)))
    listed = written(postings.join(lists, "key").select("key", "size", "x", "leaders"))
    near = written(_near_fingerprints(plain.where("n > 0").select("fp", F.struct("node", "n", *SKETCH).alias("x"))).where("x.node != y.node"))
    wanted = listed.select("x.node").union(near.select("x.node")).union(near.select("y.node")).distinct()
    sets = written(_sets(docs, distinct.join(wanted, "node")))
    links = _links(sets, _pairs(near.union(listed.select("x", F.explode("leaders").alias("y")))))
    rooted = written(_rooted(listed.select("key", "size", "x", F.col("x.node").alias("node")), links))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key")
    open_ = written(rooted.join(mixed, "key").select("key", "size", F.struct("x.*", "root").alias("x")))
    short = open_.where(F.col("size") <= limit)
    other = short.select(F.col("key").alias("same"), F.col("x").alias("y"))
    met = (F.col("key") == F.col("same")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_be_alike("x", "y")
    nodes = rooted.select("node", "root").distinct()
    links = links.union(_between_roots(_links(sets, _pairs(short.select("key", "x").join(other, met))), nodes))
    apart = written(open_.where(F.col("size") > limit).select("x.*").distinct())
    return links if apart.isEmpty() else links.union(_apart(sets, apart, limit))


def one_of_each(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Of each group that links of similarity 0.8 join the row with the smallest id, with all its columns.

    Rows without an id come last, then by text hash. Null and wordless texts are one group. Rows that repeat id and text count once.
    Texts of any length are taken whole; a set of shingles is the largest thing a task holds. An empty table stays empty. Columns
    beyond ``doc_id`` and ``text`` may have any names but ``runlens_text``, ``runlens_id`` and ``runlens_key``.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    distinct = written(_scanned(docs).groupBy("node").agg(
        first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp")))
    rooted = _rooted(distinct.select("node", "first"), _alike(docs, distinct, limit))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("runlens_id"), F.col("first.text_key").alias("runlens_key"))
    keyed = docs.withColumn("runlens_text", F.xxhash64(text_of()))
    kept = keyed.join(written(chosen), (F.col("runlens_text") == F.col("runlens_key")) & F.col("doc_id").eqNullSafe(F.col("runlens_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "runlens_text"]).drop("runlens_text")
