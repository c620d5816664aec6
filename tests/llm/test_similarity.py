"""One of each group of documents with a Jaccard similarity of 0.8 or more, against all pairs in plain Python."""

import random

import corpus_pipeline
import plain
import pytest

from runlens.llm import similarity

SMALL = "/root/testdata/sf0.001/documents.parquet"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(one, other):
    return one == other or 5 * len(one & other) >= 4 * len(one | other)


def survivors(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for d in sorted(sets):
        for e in sorted(sets):
            if d < e and root[d] != root[e] and alike(sets[d], sets[e]):
                low, high = sorted((root[d], root[e]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def words(rng, number):
    return [f"w{rng.randint(0, 10**9)}" for _ in range(number)]


def copies():
    """Pairs whose similarity is 0.8 to 0.98 and pairs somewhat below, some of both, and a chain."""
    rng, rows = random.Random(3), {}
    for k in range(40):
        base = words(rng, 400)
        tail = words(rng, (10, 20, 44, 48, 70, 120)[k % 6])
        rows[2 * k], rows[2 * k + 1] = " ".join(base), " ".join(base[len(tail) :] + tail)
    base = words(rng, 300)
    for k in range(8):
        rows[100 + k] = " ".join(base[20 * k :] + words(rng, 20 * k))
    return rows


@pytest.mark.parametrize("limit", [1, 16])
def test_one_of_each_at_every_similarity(spark, limit):
    texts = copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    expected = survivors(texts)
    assert 40 < len(expected) < len(texts) - 20
    assert sorted(r["doc_id"] for r in similarity.one_of_each(frame, limit).collect()) == expected


def shared_passage(number):
    """Texts that share 300 of their 485 words and are not alike, and two near copies of each of the first ten."""
    rng = random.Random(5)
    passage = words(rng, 300)
    rows = {k: " ".join(passage + words(rng, 185)) for k in range(number)}
    for k in range(20):
        text = rows[k // 2].split()
        rows[number + k] = " ".join(text[: 480 - k] + words(rng, 5))
    return rows


def test_a_shared_passage_makes_no_pairs_but_copies_are_found(spark, monkeypatch):
    counts, links = {}, similarity._links

    def counted(sets, pairs):
        counts[number] = counts.get(number, 0) + pairs.count()
        return links(sets, pairs)

    monkeypatch.setattr(similarity, "_links", counted)
    for number in (100, 200):
        frame = spark.createDataFrame(list(shared_passage(number).items()), "doc_id long, text string").repartition(4)
        assert sorted(r["doc_id"] for r in similarity.one_of_each(frame).collect()) == list(range(number))
    assert counts[200] < 3 * counts[100] and counts[200] < 12 * 200


def test_a_dense_group_of_unlike_copies(spark):
    """Copies of one text with a share of words changed that differs from copy to copy: some pairs are alike, most are not."""
    rng, base = random.Random(7), words(random.Random(6), 200)
    texts = {k: " ".join(w if rng.random() > rng.choice((0.0, 0.01, 0.02, 0.04, 0.08)) else f"n{rng.random()}" for w in base) for k in range(150)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in similarity.one_of_each(frame, 4).collect()) == survivors(texts)


def test_very_long_texts_and_columns_of_clashing_names(spark):
    long = " ".join(words(random.Random(9), 60_000))
    rows = [(1, long, 1, "a", 2, 3), (2, long + " more", 1, "b", 2, 3), (3, "short", 1, "c", 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int, root string, n int, `x.y` int")
    assert sorted((r["doc_id"], r["root"]) for r in similarity.one_of_each(frame).collect()) == [(1, "a"), (3, "c")]
    assert similarity.one_of_each(frame).columns == frame.columns


def test_stage_of_the_pipeline_takes_similarity(spark):
    docs = spark.read.parquet(SMALL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == survivors(texts)
    assert len(kept) < len(set(plain.components({d: plain.simhash(t) for d, t in texts.items()}).values()))


def test_columns_stay_and_odd_rows_count_once(spark):
    schema = "doc_id long, text string, more int"
    frame = spark.createDataFrame([(1, None, 7), (2, " ", 7), (3, "one", 7), (3, "one", 7), (None, "one", 7), (None, "two", 8), (5, "a b c d e f", 9), (6, "A b  c d e f", 9)], schema)
    rows = similarity.one_of_each(frame).collect()
    assert sorted((r["doc_id"] or 0, r["more"]) for r in rows) == [(0, 8), (1, 7), (3, 7), (5, 9)]
    empty = similarity.one_of_each(spark.createDataFrame([], schema))
    assert empty.schema.simpleString() == frame.schema.simpleString() and empty.count() == 0


def test_near_fingerprints_propose_pairs(spark):
    """Sets whose bands never meet are compared where their fingerprints are within four bits, and the sets still decide."""
    nodes = spark.createDataFrame([("a", 0b111, 1), ("b", 0b111, 1), ("c", 0b100, 1), ("d", -1, 1)], "node string, fp long, n int").selectExpr("fp", "struct(node, n) AS x")
    pairs = {frozenset((r.x.node, r.y.node)) for r in similarity._near_fingerprints(nodes).collect() if r.x.node != r.y.node}
    assert pairs == {frozenset("ab"), frozenset("ac")}
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["z"])), (3, "other words " * 9)], "doc_id long, text string")
    found = similarity._scanned(docs).collect()
    assert bin((found[0].fp ^ found[1].fp) & (1 << 64) - 1).count("1") <= 4
    plain_ = similarity._scanned(docs).withColumn("first", similarity.F.struct("doc_id", "text_key")).withColumn("bands", similarity.F.array().cast("array<long>"))
    links = similarity._alike(docs, similarity.written(plain_), 16).collect()
    assert [{r.a, r.b} for r in links] == [{r.node for r in found if r.doc_id < 3}]
