"""Packing with a mixture against deficit round-robin in plain Python and the tokenizer library."""

import random
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from runlens.llm import mixture

SCHEMA = "doc_id long, text string, source string"


def check(docs, rows, capacity=1024):
    """Each id in one piece, checksums, gapless sequences, full ones but for powers of two."""
    own, ids = plain.byte_tokenizer(True), {}
    for d, text, *_ in docs:
        ids.setdefault(d, []).append([*own.encode(text or "", add_special_tokens=False).ids, 0])
    for d, texts in ids.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == d)
        if len(texts) == 1:
            assert [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces)])[:-1]) and all(p[3] == len(texts[0]) for p in pieces)
        assert sum(p[1] for p in pieces) == sum(map(len, texts))
        for start, length, crc, _ in pieces:
            assert length > 0 and crc in {zlib.crc32(np.array(t[start : start + length], np.uint32).tobytes()) for t in texts}
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for own_places in places.values():
        own_places.sort()
        assert [p[0] for p in own_places] == list(np.cumsum([0, *(p[1] for p in own_places)])[:-1])
        sizes.append(sum(p[1] for p in own_places))
    assert sum(sizes) == sum(len(t) for texts in ids.values() for t in texts)
    assert all(s == capacity or (s < capacity and s & (s - 1) == 0) for s in sizes) and sum(s < capacity for s in sizes) <= 10


def test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = mixture.pack(frame).collect()
    docs = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    check(docs, rows)
    # All sources run through all sequences: after any number of them each source has had what it is due, but for a few portions.
    total, by = Counter(), {}
    for r in rows:
        total[r["source"]] += r["length"]
        by.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
    every, so_far = sum(total.values()), Counter()
    assert len(total) > 5 and every > 50 * 1024
    for k in range(every // 1024 - len(total) * mixture.PORTION // 1024 - 1):
        so_far += by[k]
        assert all(abs(so_far[s] - (k + 1) * 1024 * n / every) <= 3 * mixture.PORTION for s, n in total.items()), k


@pytest.mark.parametrize("seed", range(6))
def test_rounds_are_those_of_counters(seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice((1, 50, 3000, 20000)) + rng.randint(0, 900) for k in range(rng.randint(1, 6))}
    # Quanta of whole numbers and halves add up without rounding.
    quanta = np.array([rng.randint(1, 600) / 2 for _ in sizes])
    plan = mixture.Schedule(np.array(list(sizes.values())), quanta, rng.choice((1, 10, 64)))
    rounds = int(plan.last().max()) + 2
    taken = np.cumsum(plain.served(list(sizes.values()), quanta.tolist(), plan.portion, rounds), axis=0)
    for q in range(len(sizes)):
        assert plan.served(q, np.arange(1, rounds + 1)).tolist() == taken[:, q].tolist()
        tokens = np.arange(plan.sizes[q])
        assert plan.round_of(np.full(len(tokens), q), tokens).tolist() == np.searchsorted(taken[:, q], tokens, side="right").tolist()
    for k in range(1, rounds + 1):
        carried = plan.deficits(k)
        assert ((carried >= 0) & (carried < plan.portion)).all()


def test_targets_and_many_sources(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(("one", "two", "three")) for _ in range(rng.randint(0, 300))), f"s{k % 9}") for k in range(200)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = mixture.pack(frame, targets={"s1": 3, "s2": 1, "none": 5}).collect()
    check(docs, rows)
    first = Counter()
    for r in rows:
        if r["sequence_id"] < 3:
            first[r["source"]] += r["length"]
    assert first["s1"] > 2 * first["s2"] > 0
    monkeypatch.setattr(mixture, "MOST_QUEUES", 3)
    check(docs, mixture.place(mixture.written(mixture.encoded(frame)), most=3).collect())


def test_odd_rows(spark):
    docs = [(1, None, None), (1, None, None), (2, "", "a"), (3, "<|endoftext|> é 你好 " + "x" * 5000, "a"), (4, " " * 3000, None), (5, "word " * 30000, "b"), (6, "same", "b"), (6, "same", "b")]
    frame = spark.createDataFrame([(*d, 1, 2, "n") for d in docs], SCHEMA + ", n int, queue int, ids string")
    check(docs, mixture.pack(frame).collect())
    assert mixture.pack(frame.drop("source")).count() >= len(docs)
    assert mixture.pack(frame.limit(0)).collect() == []
