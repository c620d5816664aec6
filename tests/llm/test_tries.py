"""Prefix trie and totals of subtrees against plain Python."""

import random

import plain
import pytest

from runlens.llm import tries

SCHEMA = "conv_id long, turn int, role string, text string"


def found(frame, limit=tries.COMPONENT):
    return sorted(((*r,) for r in tries.digests(frame, limit).collect()), key=lambda r: (r[0], r[1]))


def turns(rng, convs, most, texts):
    return [(c, t, rng.choice("us"), f"{'é' * rng.randint(0, 3)}{rng.randint(0, texts)}") for c in convs for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_random_conversations(spark, limit):
    rng = random.Random(limit)
    rows = turns(rng, [c for c in range(260) if rng.random() < 0.4], 7, 1)
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), limit) == plain.trie(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(7, t, "u", f"t{t}") for t in range(60)] + [(c, t, "u", f"t{t}") for c in range(200, 230) for t in range(4)]
    rows += [(500, t, "u", "x") for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4), 5) == plain.trie(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "u", None), (1, 2, "u", None), (1, 1, "u", "é" * 5000), (None, 1, "u", "a"), (2, 1, None, "b"), (2, 1, "a", "b"), (100, 3, "s", "s"),
            (105, 0, "u", "only"), (3000, 0, "u", "z"), (3001, 0, "u", "y")]
    frame = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA + ", depth int, own int, parent string")
    assert found(frame) == plain.trie(rows)
    assert found(frame.limit(0)) == []


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(frame, 64) == plain.trie([(*r,) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_digests_of_many_ids_are_joined_from_parts(spark, monkeypatch):
    monkeypatch.setattr(tries, "TEXT", 60)
    rows = [(c, 0, "u", "same") for c in range(1, 100)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain.trie(rows)
