"""The stages of the pipeline against brute force on what each of them gets."""

import zlib

import numpy as np

import corpus_pipeline
from brute import brute_groups, brute_hits
from stipendia.llm import mixing, quality_rules, tokens
from stipendia.llm.tables import table, written


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns, name
        kept.append(docs)
    start, good, single, clean, drawn = [
        {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]

    judged = quality_rules.judged(quality_rules.measured(kept[0])).collect()
    assert set(good) == {r.doc_id for r in judged if r.kept}
    groups = brute_groups(good.items(), 5)
    assert set(single) == {i for i, (_, top) in groups.items() if i == top}
    items = [tuple(r) for r in table(spark, folder, "benchmark").select("item_id", "text").collect()]
    assert set(clean) == {i for i, _, hit, _ in brute_hits(single.items(), items) if not hit}
    chosen = {r.c0 for r in mixing.mixed(kept[3]).where("_kept").select("c0").collect()}
    assert set(drawn) == chosen and set(drawn) <= set(clean)

    found = corpus_pipeline.STAGES[-1][1](spark, kept[4], folder).collect()
    tool, at = tokens.tokenizer(corpus_pipeline.TOKENIZER), 0
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(drawn)
    for r in sorted(found, key=lambda r: r.doc_id):
        ids = [*tool.encode(drawn[r.doc_id], add_special_tokens=False).ids, corpus_pipeline.END]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_run_equals_its_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
