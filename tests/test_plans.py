import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.plans.config import IndexConfig, SearchParams
from lodevec.plans.grouping import bit_budgets, dims_to_groups, layout


@pytest.mark.parametrize(
    "wrong",
    [dict(dimension=0, groups=2), dict(dimension=8, groups=3), dict(dimension=8, groups=10), dict(dimension=10, groups=4), dict(dimension=8, groups=2, metric="cosine"), dict(dimension=9, groups=2, grouping="uneven"),
     dict(dimension=8, groups=4, max_group_dims=1), dict(dimension=8, groups=2, nlist=8), dict(dimension=8, groups=2, page_bytes=1000), dict(dimension=2048, groups=2), dict(dimension=8, groups=2, metric="dot")],
)
def test_wrong_configurations(wrong):
    with pytest.raises(ValueError):
        IndexConfig(**wrong)


def test_derived_sizes():
    c = IndexConfig(128, 50, grouping="uneven")
    assert (c.encoded_bytes, c.records_per_page, IndexConfig(128, 50, grouping="uneven", payload_bytes=128).records_per_page) == (28, 7, 31)


@pytest.mark.parametrize("wrong", [dict(k=0), dict(z=-1.0), dict(z=float("inf")), dict(k=10, limit=5), dict(nprobe=0)])
def test_wrong_searches(wrong):
    with pytest.raises(ValueError):
        SearchParams(**wrong)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(1e-6, 1e6), min_size=8, max_size=32).filter(lambda v: len(v) % 2 == 0))
def test_budgets_spend_all_bits_and_layouts_are_partitions(variance):
    v = np.array(variance)
    budgets = bit_budgets(v, 4)
    assert np.isclose(budgets.sum(), 16) and (budgets >= 0).all()
    groups = layout(v, 4)
    sizes = [len(g) for g in groups]
    assert sorted(np.concatenate(groups)) == list(range(len(v))) and min(sizes) >= 1
    assert all(sizes.count(s) % 2 == 0 for s in set(sizes))


def test_constant_vectors_have_no_budget():
    with pytest.raises(ValueError):
        bit_budgets(np.zeros(4), 2)


def test_swaps_even_out_loads():
    budgets = np.array([8.0, 7.0, 1.0, 1.0])
    group = dims_to_groups(budgets, np.array([2, 2]))
    assert sorted(np.bincount(group, budgets)) == [8.0, 9.0]
