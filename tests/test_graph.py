import itertools
import random

from pyspark.sql import functions as F

from cashtrail.operators import candidates, graph

EDGE = "txn_id long, complaint_id string, src_account string, dst_account string, amount double, ts_s long, hop_depth int, is_terminal int"


def edges(spark, rows):
    return spark.createDataFrame([(i, c, s, t, float(a), ts, h, z) for i, (c, s, t, a, ts, h, z) in enumerate(rows)], EDGE)


def test_velocity_needs_three_in_300_seconds(spark):
    fast = [("c", "A", f"x{i}", 10, i * 30, 1, 0) for i in range(5)]
    edge = [("c", "B", f"y{i}", 10, i * 150, 1, 0) for i in range(3)]
    slow = [("c", "C", f"z{i}", 10, i * 151, 1, 0) for i in range(3)]
    two = [("c", "D", "w", 10, 0, 1, 0), ("c", "D", "v", 10, 1, 1, 0)]
    assert {r.account_id for r in graph.velocity_flags(edges(spark, fast + edge + slow + two), ["complaint_id"]).collect()} == {"A", "B"}


def test_even_split(spark):
    rows = [("c", "A", f"x{i}", 100000 * f, i, 1, 0) for i, f in enumerate((1, 1.05, 1.10, 1.15))]
    rows += [("c", "B", f"y{i}", a, i, 1, 0) for i, a in enumerate((10, 10, 100))] + [("c", "C", "z", 5, 1, 1, 0)] * 2
    assert [r.account_id for r in graph.split_flags(edges(spark, rows)).collect()] == ["A"]


def test_collapse_keeps_last_or_first(spark):
    e = edges(spark, [("c", "A", "B", 1, 0, 1, 0), ("c", "A", "B", 2, 5, 1, 0)])
    assert graph.collapse_edges(e).head().amount == 2 and graph.collapse_edges(e, "first").head().amount == 1


def test_trace(spark):
    e = edges(spark, [("c", "V", "A", 1, 0, 1, 0), ("c", "A", "B", 1, 1, 2, 0), ("c", "B", "A", 1, 2, 3, 0), ("c", "B", "T", 1, 3, 4, 1), ("d", "X", "V", 1, 3, 1, 0)])
    starts = spark.createDataFrame([("t1", "V"), ("t2", "nobody")], "trace_id string, account_id string")
    got = {(r.trace_id, r.account_id): r.depth for r in graph.trace(starts, e).collect()}
    assert got == {("t1", "V"): 0, ("t1", "A"): 1, ("t1", "B"): 2, ("t1", "T"): 3}
    assert {r.account_id for r in graph.trace_terminals(graph.trace(starts, e), e).collect()} == {"T"}
    assert graph.trace(starts, e, 1).count() == 2
    by_case = {(r.complaint_id, r.account_id) for r in graph.trace_complaints(e).collect()}
    assert ("d", "T") in by_case and ("c", "X") not in by_case


def test_bit_traces_of_many_complaints(spark, monkeypatch):
    """More walks than a row holds, complaints with several origins, shared origins, circles and a hub, against plain search."""
    rnd = random.Random(11)
    monkeypatch.setattr(graph, "TRACE_WORDS", 2)
    monkeypatch.setattr(graph, "WORD_COLUMNS", ["w0", "w1"])
    monkeypatch.setattr(graph, "WALK_BITS", 128)
    names = [f"n{i}" for i in range(300)]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(360)] + [("n0", n) for n in names[1:60]] + [("n5", "n5")]
    rows = [(None, s, t, 1, 0, 2, 0) for s, t in pairs]
    origins = {f"c{i}": set(rnd.sample(names, rnd.choice((1, 1, 1, 2, 3)))) for i in range(420)} | {"twin1": {"n7"}, "twin2": {"n7"}}
    out = {n: [t for s, t in pairs if s == n] for n in names}
    ends = {c: {o: rnd.choice(names) for o in found} for c, found in origins.items()}
    for c, found in origins.items():
        for o in found:
            rows.append((c, o, ends[c][o], 1, 0, 1, 0))
            out[o].append(ends[c][o])
    want = {}
    for c, found in origins.items():
        seen = {o: 0 for o in found}
        frontier = set(found)
        for depth in range(1, 6):
            frontier = {t for s in frontier for t in out[s]} - set(seen)
            seen |= {t: depth for t in frontier}
        want[c] = seen
    e = edges(spark, rows)
    got = {}
    for r in graph.trace_complaints(e).collect():
        assert got.setdefault(r.complaint_id, {}).setdefault(r.account_id, r.depth) == r.depth
    assert got == want
    reach = {r.complaint_id: (r.reached, r.deepest, r.weight_sum) for r in graph.complaint_reach(e, F.length("account_id")).collect()}
    assert reach == {c: (len(x), max(x.values()), sum(map(len, x))) for c, x in want.items()}
    asked = spark.createDataFrame([("c3",), ("twin2",), ("nobody",)], "complaint_id string")
    assert {r.complaint_id for r in graph.trace_complaints(e, asked).collect()} == {"c3", "twin2"}
    assert graph.trace_complaints(e.limit(0)).count() == 0 and graph.complaint_reach(e.limit(0)).count() == 0


def test_components(spark):
    rows = [("c", f"n{i}", f"n{i + 1}", 1, 0, 1, 0) for i in range(40)] + [("c", "p", "q", 1, 0, 1, 0), ("c", "s", "s", 1, 0, 1, 0)]
    got = {r.account_id: r.component for r in graph.components(edges(spark, rows)).collect()}
    assert {got[f"n{i}"] for i in range(41)} == {"n0"} and got["q"] == "p" and got["s"] == "s"


def test_crew_prior_with_and_without_hubs(spark):
    rnd = random.Random(7)
    names = [f"a{i}" for i in range(60)]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(55)] + [("a0", n) for n in names[1:20]]
    near = {n: {n} for n in names}
    for s, t in pairs:
        near[s].add(t)
        near[t].add(s)
    reach = {}
    for n in names:
        seen, frontier = {n}, {n}
        for _ in range(3):
            frontier = set(itertools.chain.from_iterable(near[x] for x in frontier)) - seen
            seen |= frontier
        reach[n] = seen
    past = [(n, m, 1 + i % 3) for i, (n, m) in enumerate((n, m) for n in names[::2] for m in (1, 2))]
    want = {(a, m): sum(k for n, mm, k in past if mm == m and n in reach[a]) for a in names for m in (1, 2)}
    e = edges(spark, [("c", s, t, 1, 0, 1, 0) for s, t in pairs])
    targets = spark.createDataFrame([(a, m) for a in names for m in (1, 2)], "account_id string, atm_id int")
    history = spark.createDataFrame(past, "account_id string, atm_id int, n long")
    for degree in (10**9, 6):
        got = {(r.account_id, r.atm_id): r.crew_prior for r in candidates.crew_prior(targets, e, history, hub_degree=degree).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_rows_of_a_trace_come_after_the_join(spark):
    """A trace joins bits with lists of complaints and only then makes a row per complaint and account."""
    rows = [(i, i + 1, 1000 + i, 1) for i in range(6)]
    moves = spark.createDataFrame(rows, "src_account long, dst_account long, complaint_id long, hop_depth long")
    found = graph.trace_complaints(moves, max_depth=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    assert sorted(map(tuple, found.collect())) == sorted((1000 + i, i + k, k) for i in range(6) for k in range(3) if i + k <= 6)
