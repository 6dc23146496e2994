"""The pipeline against plain Python, stage by stage."""

from tests.llm.test_filters import WORD, counts
from tests.llm.test_near_copies import plain_groups
from tracewright.llm import decontaminate
from tracewright.session import materialize

import corpus_pipeline


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        given, seen = seen, materialize(stage(spark, seen, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
        kept.append({r.doc_id for r in seen.collect()})
        texts = {r.doc_id: r.text for r in given.collect()}
        if name == "quality_rules":
            base = {i for i, t in texts.items() if counts(t)[0] < 20 or 100 * counts(t)[4] > 30 * counts(t)[0]}
            assert not base & kept[-1]
        elif name == "near_duplicates":
            assert kept[-1] == set(plain_groups(texts).values())
        elif name == "decontamination":
            hit = {
                i for i, t in texts.items()
                if any(2 * sum(s for *_, s in decontaminate.tiles(p, WORD.findall(t.lower()))) >= len(p) for p in items.values())
            }
            assert kept[-1] == set(texts) - hit
        else:
            assert kept[-1] == set(texts)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == kept[-1] and all(r.restored for r in whole)
