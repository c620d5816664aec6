"""Stages of the corpus pipeline against plain Python on the smallest documents."""

import corpus_pipeline
import plain
import test_similarity

from runlens.llm import language, packing, recompression, texts

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {d: t for d, t in given.items() if any(map(str.isalpha, t))}
    kept = {d: kept[d] for d in test_similarity.survivors(kept)}
    assert len(kept) < len(given) - 5
    order = sorted(kept)
    passages = dict(zip(order, plain.without_repeats([kept[d] for d in order])))

    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    known, single, cut, clean = seen
    assert sorted(known) == sorted(d for d, t in given.items() if any(map(str.isalpha, t)))
    assert single == kept
    for d, (_, removed, rest) in passages.items():
        assert " ".join(plain.WORD.findall(cut[d])) == rest and (removed or cut[d] == kept[d])
    assert sorted(clean) == order
    for d, text in clean.items():
        assert not plain.personal(text) and (plain.personal(cut[d]) or text.replace("[", "") == cut[d].replace("[", ""))
    places = {d: plain.packed(t) for d, t in clean.items()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == {
        (d, p): v for d, own in places.items() for p, v in own.items()}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in corpus_pipeline.run(spark, SF).collect()} == {
        (d, p): v[2] for d, own in places.items() for p, v in own.items()}


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_remembers_for_one_operator_at_a_time():
    memories = {language: language._MODELS, recompression: recompression._WORDS}
    for own in memories:
        language._MODELS["model"] = None
        recompression._WORDS[b"word"]
        packing._word_ids(packing.TOKENIZER)
        texts.only(own.__name__)
        assert [bool(memory) for memory in memories.values()] == [module is own for module in memories]
        assert packing._word_ids.cache_info().currsize == 0
    packing._word_ids(packing.TOKENIZER)
    texts.only(packing.__name__)
    assert packing._word_ids.cache_info().currsize == 1 and not recompression._WORDS
