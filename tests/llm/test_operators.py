"""Operators against plain Python, on the smallest documents and on rows that are hard to treat."""

import random
import zlib
from collections import defaultdict

import numpy as np
import plain
import pytest

from runlens.llm import language, packing, pieces, pii, quality, recompression, revisits, sharding, simhash, winnowing

SMALL = "/root/testdata/sf0.001/documents.parquet"
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, spans string, shard int, rank int, `end` int"


def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta eins zwei drei é ß 中文 x.".split()) + str(rng.randint(0, 60)) for _ in range(12_000))
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [
        None, "", "   \n\t ", "one", "The end.", passage, f"before {passage} after", passage.upper(), "a " * 70, "a b " * 40, long, long[:5000],
        "mail me at x.y@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1", "same text twice\nsame text twice\n",
        "ÀÉ ñ İ ﬁ J̌ 😀 <|endoftext|> </s> ▁ \x00 end", "#" * 50, "no_space" * 3000,
    ]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, passage, "en", "s1", 3), (None, None, None, None, None), (None, "lost words", "de", "s2", 1)]
    return [(*r, 1, 0.5, "x", 2, 3, 4) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(SMALL).cache()


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def own(frame):
    """Rows of the odd table by id, those without one left out."""
    return {k: r for k, r in by_id(frame).items() if k is not None}


ODD = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
COUNT = len(odd_rows())


@pytest.mark.parametrize("operator", [
    packing.pack, simhash.digests, language.digests, winnowing.digests, recompression.digests, sharding.digests, pieces.digests, pii.digests, quality.verdicts,
])
def test_empty_table(spark, operator):
    frame = operator(spark.createDataFrame([], ODD_SCHEMA))
    assert frame.columns and frame.count() == 0


@pytest.mark.parametrize("stage", [language.known_language, simhash.one_of_each, recompression.without_repeats, pii.redact])
def test_stages_keep_columns(spark, odd, stage):
    for frame in (odd, spark.createDataFrame([], ODD_SCHEMA)):
        out = stage(frame)
        assert out.schema.simpleString() == frame.schema.simpleString()
        assert out.count() <= frame.count()


def check_places(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences), sum(r["length"] for r in rows)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_packing(request, table, texts):
    rows = packing.pack(request.getfixturevalue(table)).collect()
    expected = {(d, p): v for d, t in (texts if table == "small" else ODD).items() for p, v in plain.packed(t).items()}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] is not None} == expected
    number, tokens = check_places(rows)
    assert number <= -(-tokens // 4096) + 1


def test_packing_holds_each_length_once_and_nearly_fills():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4096, 3000), np.minimum(4095, rng.lognormal(6, 1, 5000).astype(int) + 1), np.full(100, 2049), np.array([7])):
        histogram = dict(zip(*np.unique(lengths, return_counts=True)))
        plan, used = packing.solve(histogram), defaultdict(int)
        for content, number in plan:
            assert sum(content) <= 4096 and number > 0
            for s in content:
                used[s] += number
        assert used == {int(s): int(n) for s, n in histogram.items()}
        bound = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
        assert sum(n for _, n in plan) <= 1.01 * bound + 1


def test_packed_sequences_hold_the_ids(small, texts):
    packed = packing.pack(small.where("doc_id < 20"), keep_ids=True)
    lengths = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert sum(lengths.values()) == sum(sum(v[1] for v in plain.packed(texts[d]).values()) for d in range(20))


@pytest.mark.parametrize("table", ["small", "odd"])
def test_simhash(request, table, texts):
    given = texts if table == "small" else ODD
    rows = by_id(simhash.digests(request.getfixturevalue(table)))
    prints = {d: plain.simhash(t) for d, t in given.items()}
    expected = plain.components(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in rows.items() if d is not None} == {d: (f"{prints[d]:016x}", expected[d]) for d in given}


def test_any_four_positions_hold_a_triple():
    from itertools import combinations
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [2, 5, 10_000])
def test_long_posting_lists_lose_no_link(spark, limit):
    rng, prints = random.Random(2), {}
    for base in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(40):
            value = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            prints[value] = value
    for _ in range(60):  # four bytes alike, the others free
        value = 0x0102030400000000 | rng.getrandbits(32)
        prints[value] = value
    signed = {v - (1 << 64) if v >> 63 else v: v for v in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = [(r["a"], r["b"]) for r in simhash.links(frame, limit).collect()]
    assert all((signed[a] ^ signed[b]).bit_count() <= 4 for a, b in pairs)
    from runlens.llm.components import components
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, limit)).collect()}
    groups, expected = defaultdict(set), defaultdict(set)
    for s, v in signed.items():
        groups[found.get(s, s)].add(v)
    for v, root in plain.components(prints).items():
        expected[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_one_of_each(odd, small, texts):
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(small).collect())
    assert kept == sorted(set(plain.components({d: plain.simhash(t) for d, t in texts.items()}).values()))
    ids = [r["doc_id"] for r in simhash.one_of_each(odd).collect()]
    assert ids.count(5) == 1 and ids.count(0) == 1 and ids.count(None) == 1


def test_components_of_a_long_chain(spark):
    from runlens.llm.components import components
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_language(small, odd):
    rows = language.digests(small).collect()
    truth = by_id(small)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    found = own(language.digests(odd))
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == found[15]["lang_pred"] == "und"
    assert found[4]["lang_pred"] != "und"


def test_language_without_labels(spark):
    frame = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.digests(frame).collect()} == {"und"}
    assert language.known_language(frame).count() == 2


def test_segmentations_are_summed():
    numbers, size = language.vocabulary(language.VOCABULARY)
    rng = np.random.default_rng(0)
    table = rng.random((size, 2)) / size
    model = language.Pieces(language.VOCABULARY, table)

    def total(text, k):
        if not text:
            return 1.0
        return sum(table[numbers[text[:n]], k] * total(text[n:], k) for n in range(1, len(text) + 1) if text[:n] in numbers)

    for word in ("the", "other", "straße"):
        assert np.allclose(np.frombuffer(model.logs(word)), [np.log(total("▁" + word, k)) for k in (0, 1)])
    assert np.isfinite(np.frombuffer(model.logs("ab中" * 3000))).all()


@pytest.mark.parametrize("table", ["small", "odd"])
def test_winnowing(request, table, texts):
    given = texts if table == "small" else ODD
    rows = by_id(winnowing.digests(request.getfixturevalue(table)))
    order = sorted(given, reverse=True)
    for d, following in zip(order, order[1:] + order[:1]):
        text, other, r = given[d] or "", given[following] or "", rows[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), plain.sha(edited))
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1 or edited != text)
    prints = defaultdict(set)
    for d, t in given.items():
        prints[tuple(plain.WORD.findall(t or ""))].add(rows[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_winnowing_places_leave_no_gap(small):
    for r in winnowing.fingerprints(small).collect():
        places = r["places"]
        assert places == sorted(set(places))
        assert all(b - a <= winnowing.WINDOW for a, b in zip(places, places[1:]))


def test_winnowing_takes_the_rightmost_of_equal_hashes(spark):
    frame = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    places = winnowing.fingerprints(frame).first()["places"]
    assert places == list(range(winnowing.WINDOW - 1, 28))


@pytest.mark.parametrize("table", ["small", "odd"])
def test_substrings(request, table, texts):
    given = texts if table == "small" else ODD
    rows = by_id(recompression.digests(request.getfixturevalue(table)))
    order = sorted(given)
    for d, (total, removed, kept) in zip(order, plain.without_repeats([given[d] for d in order])):
        assert (rows[d]["n_words"], rows[d]["n_removed"], rows[d]["kept_sha256"]) == (total, removed, plain.sha(kept))


@pytest.mark.parametrize("seed", range(4))
def test_substrings_of_few_words(spark, seed):
    rng = random.Random(seed)
    words = [chr(97 + k) for k in range(rng.choice([1, 2, 3, 6]))]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(25):
        at = rng.randint(0, 60)
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 40))] + base[at : at + rng.randint(0, 40)]))
    rows = by_id(recompression.kept_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 7))
    assert [(rows[d]["n_words"], rows[d]["n_removed"], rows[d]["kept"]) for d in range(25)] == plain.without_repeats(texts, 7)


def test_repeats_are_cut_in_place(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    frame = spark.createDataFrame([(1, passage, 9), (2, f"first\nline {passage} rest\tof it", 9)], "doc_id long, text string, n_chars long")
    rows = by_id(recompression.without_repeats(frame))
    assert (rows[1]["text"], rows[1]["n_chars"]) == (passage, 9)
    assert (rows[2]["text"], rows[2]["n_chars"]) == ("first\nline rest\tof it", 21)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_shards(request, table, texts):
    frame = request.getfixturevalue(table)
    rows = sharding.digests(frame).collect()
    assert len(rows) == frame.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    given = texts if table == "small" else ODD
    for r in rows:
        if r["doc_id"] is not None:
            data = (given[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


def test_one_more_shard_moves_few_rows(small):
    before, after = (by_id(sharding.shards(small, n)) for n in (8, 9))
    moved = sum(before[d]["shard"] != after[d]["shard"] for d in before)
    assert moved < 0.5 * len(before)


def test_many_equal_rows_fill_slots(spark):
    frame = spark.createDataFrame([(1, "x")] * 500 + [(None, "y")] * 300, "doc_id long, text string")
    rows = sharding.digests(frame).collect()
    slots = defaultdict(set)
    for r in rows:
        slots[r["shard"]].add(r["slot"])
    assert len(rows) == 800 and sorted(map(len, slots.values())) == [33] * 16 + [34] * 8


@pytest.mark.parametrize("table", ["small", "odd"])
def test_pieces(request, table, texts):
    given, model = texts if table == "small" else ODD, plain.pieces()
    for d, r in by_id(pieces.digests(request.getfixturevalue(table))).items():
        if d is not None:
            ids = model.encode(given[d] or "")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(model.decode(ids)))


def test_pieces_of_random_texts():
    rng, model, codec = random.Random(1), plain.pieces(), pieces.codec()
    parts = ["a", "b", "th", "er", "on", " ", "  ", "   ", "\n", "é", "ß", "▁", "\t", "1", "2", ".", "中", "😀", "\x00", "</s>", "<0x0A>", "the", "Ing", " " * 19, "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = model.encode(text)
        assert codec.encode(text).tolist() == ids and codec.decode(ids) == model.decode(ids)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_personal_data(request, table, texts):
    given = texts if table == "small" else ODD
    for d, r in by_id(pii.digests(request.getfixturevalue(table))).items():
        if d is not None:
            base = plain.personal(given[d])
            assert r["base_sha256"] == plain.sha(plain.joined(base))
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in base) for n in range(4)]
            assert set(filter(None, plain.joined(base).split(","))) <= set(r["spans"].split(","))


def test_personal_data_rules_on_random_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@@", "x-1", ".", "..", "1", "12", "255", "256", " ", "-", "+", "+1", "(555)", "4111111111111111", "10.0.0.1", "é", "\n", "555 1234"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain.personal(text), text


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"notes {i} please dial number +1 (555) 010-{1000 + i} before noon and go") for i in range(12)]
    rows += [(50, "notes please dial number (555) 777-8899 before noon and go"), (51, "in the year 1999 we met 40 times")]
    spans = by_id(pii.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    assert spans[50]["spans"] == "phone:25:39" and spans[50]["n_phone"] == 0
    assert spans[51]["spans"] == ""
    text = by_id(pii.redact(spark.createDataFrame(rows, "doc_id long, text string")))
    assert text[50]["text"] == "notes please dial number [PHONE] before noon and go"
    assert text[3]["text"] == "notes 3 please dial number [PHONE] before noon and go"


@pytest.mark.parametrize("table", ["small", "odd"])
def test_quality(request, table, texts):
    given = texts if table == "small" else ODD
    for d, r in by_id(quality.verdicts(request.getfixturevalue(table))).items():
        if d is not None:
            expected = plain.measures(given[d])
            assert tuple(r[m] for m in quality.MEASURES) == expected
            assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
            assert not (r["base_failed"] and r["kept"])


def test_hosts_are_condemned_by_shrunk_rates(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, f"good{i % 5}") for i in range(200)]
    rows += [(300 + i, "short", "bad") for i in range(60)] + [(400, good, "bad")]
    rows += [(500, "short", "new"), (501, good, "new"), (502, good, None)]
    kept = {d: r["kept"] for d, r in by_id(quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"))).items()}
    assert not kept[400] and kept[501] and kept[502] and all(kept[i] for i in range(200))
