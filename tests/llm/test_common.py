import random

import pytest
from helpers import components

from tessera.llm.common import connected_components


@pytest.mark.parametrize(("seed", "one_task"), [(0, 0), (1, 0), (2, 0), (2, 1000)])
def test_components(spark, seed, one_task):
    rng = random.Random(seed)
    ids = list(range(60))
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), one_task).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components({x for e in real for x in e}, real)
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
