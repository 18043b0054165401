import random

from papyra.llm.components import connected


def brute(links):
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in list(up)}


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    shapes = {
        "chain": [(i, i + 1) for i in range(60)],
        "shuffled chain": [(p, q) for p, q in zip(*(lambda s: (s, s[1:]))(rng.sample(range(1000), 50)))],
        "star": [(500, i) for i in range(40)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }
    for name, links in shapes.items():
        got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
        want = brute([p for p in links if p[0] != p[1]])
        assert got == want, name


def test_no_links(spark):
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
