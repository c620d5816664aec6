"""Alignment of two tokenizers against all byte ranges in plain Python."""

import random

import numpy as np
import plain
import pytest

from runlens.llm import alignment


def found(frame, most=alignment.CHUNK_LINKS):
    return {r["doc_id"]: (*r,)[1:] for r in alignment.alignments(frame, most).collect()}


@pytest.mark.parametrize("seed", range(20))
def test_galloping_search(seed):
    rng = np.random.default_rng(seed)
    for _ in range(100):
        long = np.unique(rng.integers(0, rng.integers(2, 500), rng.integers(1, 300)))
        short = np.unique(rng.integers(-3, 520, rng.integers(0, len(long) + 1)))[: len(long)]
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").repartition(3)
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert found(frame, 3000) == dict(zip([d for d, _ in docs], plain.aligned([t for _, t in docs])))


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve 你好 \U0001f600\u0301", "x\u2581y", "tab\there\n\n  two", "\u0000a", "same words here", "same words here",
             "".join(chr(rng.choice((rng.randint(32, 126), rng.randint(160, 1500), rng.randint(0x4E00, 0x4F00)))) for _ in range(200))]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, chunk int, pairs string")
    assert found(frame, 20) == dict(enumerate(plain.aligned(texts)))
    assert found(frame.limit(0)) == {}


def test_very_long_text_and_repeated_rows(spark):
    text = "some words, and other-words; " * 20000
    frame = spark.createDataFrame([("a", text), ("b", "some"), ("b", "some")], "doc_id string, text string")
    rows = alignment.alignments(frame).collect()
    assert len(rows) == 3 and len({(*r,) for r in rows if r["doc_id"] == "b"}) == 1
    long = next(r for r in rows if r["doc_id"] == "a")
    own = alignment.tokens()
    assert (long["n_a"], long["n_b"]) == (len(own.a.encode(" " + text)), len(own.b.encode(text)))
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"]
