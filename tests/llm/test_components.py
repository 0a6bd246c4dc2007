import random

from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch


def test_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(10, 60)] + [(3, 3)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
