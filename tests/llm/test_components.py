from polystore.llm import components
from tests.llm import brute


def test_rounds_go_on_until_nothing_changes(spark):
    place = lambda k: k * 37 % 101
    path = [(place(k), place(k + 1)) for k in range(100)]
    found = dict(map(tuple, components.components(spark.createDataFrame(path, "a long, b long"), 0).collect()))
    assert found == dict.fromkeys(range(101), 0)


def test_both_ways_agree(spark):
    import random

    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    nodes = sorted({x for a, b in pairs for x in (a, b) if a != b})
    place = {x: i for i, x in enumerate(nodes)}
    near = {(place[a], place[b]) for a, b in pairs if a != b}
    roots = brute.components(list(range(len(nodes))), lambda x, y: (x, y) in near or (y, x) in near)
    want = {nodes[i]: nodes[r] for i, r in enumerate(roots)}
    for few in (0, 10**6):
        assert dict(map(tuple, components.components(edges, few).collect())) == want
    assert components.components(edges.limit(0)).count() == 0
