"""Components against a union-find."""

import random

import pytest

from parallaxis.llm import graph


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


RNG = random.Random(5)
GRAPHS = {
    "none": [],
    "loops alone": [(4, 4), (4, 4)],
    "a chain in order": [(i, i + 1) for i in range(300)],
    "a chain in no order": (lambda p: list(zip(p, p[1:])))(RNG.sample(range(400), 400)),
    "a star": [(500, i) for i in range(200)] + [(i, 500) for i in range(50)],
    "a clique twice": [(a, b) for a in range(30) for b in range(30)] * 2,
    "many": [(RNG.randrange(600), RNG.randrange(600)) for _ in range(350)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.c: r.label for r in got} == brute(edges) and len(got) == len(brute(edges))
