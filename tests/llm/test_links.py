import random

from scriptorium.llm import links


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    scattered = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)]
    stars = [(i, 1000) for i in range(50)] + [(2000, i) for i in range(100, 150)] + [(5, 5), (7, 1000)]
    for edges in (chain, scattered, stars, []):
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        found = {r.u: r.component for r in links.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert found == {x: root(x) for x in list(parent)}
