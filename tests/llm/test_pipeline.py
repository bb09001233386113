"""The pipeline, stage by stage, against plain Python on the smallest tables."""

import corpus_pipeline
from test_dedup import plain_near

from lodevec.llm import queries
from lodevec.llm.common import written


def test_stages(spark, tiny):
    import sentencepiece

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    clash = docs.withColumnsRenamed({"n_chars": "kept"})  # an extra column under a result's name
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "piece encoding"]
    steps = [f for _, f in corpus_pipeline.STAGES]

    good = written(steps[0](spark, clash, tiny), "t")
    assert good.columns == clash.columns
    kept = {r.doc_id for r in queries.op8_quality_rules(spark, tiny).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    exact = written(steps[1](spark, good, tiny), "t")
    best = {}
    for i in kept:
        best[before[i].text] = max(i, best.get(before[i].text, -1))
    assert exact.columns == clash.columns and sorted(r.doc_id for r in exact.collect()) == sorted(best.values())

    near = written(steps[2](spark, exact, tiny), "t")
    rows = [(i, before[i].text) for i in sorted(best.values())]
    alone = sorted(i for i, _, component in plain_near(rows) if i == component)
    assert near.columns == clash.columns and sorted(r.doc_id for r in near.collect()) == alone

    mixed = written(steps[3](spark, near, tiny), "t")
    taken = [r.doc_id for r in mixed.collect()]
    size = lambda ids: sum(len(before[i].text.split()) for i in ids)
    assert mixed.columns == clash.columns and set(taken) <= set(alone) and max(taken.count(i) for i in set(taken)) <= 2
    assert 0.9 * 1.5 * size(alone) <= size(taken) <= 1.5 * size(alone)

    library = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    out = steps[4](spark, mixed, tiny).collect()
    assert sorted(r.doc_id for r in out) == sorted(taken) and all(r.ids == library.encode(before[r.doc_id].text) for r in out)


def test_run_is_the_stages(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == ["doc_id", "source", "ids", "n_ids"] and out.count() > 0
    empty = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, tiny), "t")
    assert empty.count() == 0
