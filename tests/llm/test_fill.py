"""Mixing: what is left of a source's target is filled from all its documents."""

import random

import pytest

from lodevec.llm.mixing import MixParams, mix_plan


@pytest.mark.parametrize("seed", [0, 3])
def test_no_untaken_document_fits(spark, seed):
    draw = random.Random(seed)
    rows = [(i, "w " * draw.randrange(5, 60), "abc"[i % 3]) for i in range(900)]
    rows += [(1000 + i, "w " * 9_000, "abc"[i]) for i in range(3)]  # about half of each source's words
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_plan(docs, MixParams(block_words=300, share=100, seed=seed)).select("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "_copies").collect()
    assert len(got) == len(rows) and all(0 <= c.shard < 16 for r in got for c in r._copies)
    for s in "abc":
        mine = [r for r in got if r.source == s]
        whole = int(mine[0]._target // mine[0]._source_size)
        assert all(len(r._copies) in (whole, whole + 1) for r in mine)
        left = mine[0]._target - sum(r._size * len(r._copies) for r in mine)
        rest = [r._size for r in mine if len(r._copies) == whole]
        assert left > -1e-6 and (not rest or min(rest) > left)
