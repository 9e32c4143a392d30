import random

import pytest

from lodestone.llm.components import components


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(8)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(9, i) for i in range(30)], "none": [(3, 3)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]}[shape]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + edges[:2], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
