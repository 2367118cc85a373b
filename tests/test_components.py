"""Connected components against union-find in plain Python, in one task and by contraction."""

import random

import pytest

from cohortline.operators.components import connected_components


def truth(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in links:
        a, z = sorted((root(u), root(v)))
        parent[z] = a
    linked = {x for u, v in links if u != v for x in (u, v)}
    return {x: root(x) for x in linked}


@pytest.mark.parametrize("local_links", [1_000_000, 20, 0])
def test_components(spark, local_links):
    rnd = random.Random(local_links)
    ids = list(range(400))
    rnd.shuffle(ids)
    chain = list(zip(ids[:120], ids[1:120]))                       # a long chain with shuffled ids
    hub = [(ids[120], x) for x in ids[121:260]] * 2                # a hub, each link twice
    few = [(rnd.choice(ids[260:]), rnd.choice(ids[260:])) for _ in range(90)]
    links = chain + hub + few + [(ids[0], ids[0])]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    got = connected_components(df, local_links).collect()
    assert len(got) == len({r["id"] for r in got}) and {r["id"]: r["comp"] for r in got} == truth(links)


def test_components_of_text_ids_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert sorted(map(tuple, connected_components(df).collect())) == want
    assert sorted(map(tuple, connected_components(df, 0).collect())) == want
    assert connected_components(df.limit(0)).count() == 0
