import itertools
import random

from cashtrail.operators import nearness


def _ball(near, start, steps):
    seen = {start}
    for _ in range(steps):
        seen |= set(itertools.chain.from_iterable(near.get(x, ()) for x in seen))
    return seen


def test_within_three_on_a_grid_of_many_tasks(spark, monkeypatch):
    """Every task holds a small share of links and pairs, whatever their number; before, each pair was joined with all links of its account."""
    rnd = random.Random(3)
    for size in ("LINKS_A_TASK", "PAIRS_A_TASK", "CELLS", "FOLLOWED"):
        monkeypatch.setattr(nearness, size, 60)
    links = {tuple(rnd.sample(range(90), 2)) for _ in range(95)}
    links |= {(b, a) for a, b in links}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    asked = [(a, b) for a in range(0, 95, 2) for b in range(0, 95, 3)]
    want = {(a, b) for a, b in asked if b in _ball(near, a, 3)}
    assert len(want) < len(asked)
    pairs = spark.createDataFrame(asked + asked[:5] + [(None, 1), (1, None)], "a long, b long")
    got = [(r.a, r.b) for r in nearness.within_three(pairs, spark.createDataFrame(sorted(links), "a long, b long")).collect()]
    assert sorted(got) == sorted(want)
    names = [(f"n{a}", f"n{b}") for a, b in asked]
    text = nearness.within_three(spark.createDataFrame(names, "a string, b string"), spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in sorted(links)], "a string, b string"))
    assert sorted((r.a, r.b) for r in text.collect()) == sorted((f"n{a}", f"n{b}") for a, b in want)
    none = spark.createDataFrame([], "a long, b long")
    assert [(r.a, r.b) for r in nearness.within_three(pairs.filter("a = 0 and b = 0"), none).collect()] == [(0, 0)]
