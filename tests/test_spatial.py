import math

import numpy as np
import pytest

from cashtrail.operators import candidates, choice, spatial


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def world(spark, n=150, m=80, seed=1):
    """A dense town, a far fringe and both signs of latitude and longitude."""
    rng = np.random.default_rng(seed)
    pts = [(i, float(x), float(y), int(i % 7), int(i * 17 % 50)) for i, (x, y) in enumerate(zip(rng.normal(0.02, 0.05, n), rng.normal(-0.01, 0.05, n)))]
    pts += [(n + i, float(rng.uniform(-30, 30)), float(rng.uniform(-60, 60)), i % 7, i) for i in range(20)]
    qs = [(i, float(x), float(y), i % 9) for i, (x, y) in enumerate(zip(rng.normal(0, 0.5, m), rng.normal(0, 0.5, m)))] + [(m, 25.0, 50.0, 1), (m + 1, 0.02, -0.01, 2)]
    return (pts, qs, spark.createDataFrame(pts, "atm_id int, lat double, lon double, bank_id int, fraud_count int"),
            spark.createDataFrame(qs, "account_id int, lat double, lon double, bank_id int"))


@pytest.mark.parametrize("k", [3, 25, 500])
def test_nearest_k(spark, k):
    pts, qs, points, queries = world(spark)
    got = {}
    for r in spatial.nearest_k(queries, points, k).collect():
        got.setdefault((r.lat, r.lon), []).append((r.rank, r.atm_id))
    for _, lat, lon, _b in qs:
        want = [p[0] for p in sorted(pts, key=lambda p: (km(lat, lon, p[1], p[2]), p[0]))][:k]
        assert [i for _, i in sorted(got[(lat, lon)])] == want


def test_counts_in_circles(spark):
    pts, qs, points, queries = world(spark)
    for r in spatial.count_within(queries, points, 5.0, "n").collect():
        assert r.n == sum(km(r.lat, r.lon, p[1], p[2]) <= 5.0 for p in pts)
    circles = queries.selectExpr("lat", "lon", "double(account_id % 40) as km")
    for r in spatial.count_in_circles(circles, points, "n").collect():
        assert r.n == sum(km(r.lat, r.lon, p[1], p[2]) <= r.km for p in pts)


def test_same_bank(spark):
    pts, qs, points, queries = world(spark)
    got = {r.account_id: r for r in candidates.same_bank_nearest(queries, points).collect()}
    for i, lat, lon, bank in qs:
        own = [km(lat, lon, p[1], p[2]) for p in pts if p[3] == bank]
        assert abs(got[i].same_bank_km - (min(own) if own else 999.0)) < 1e-6
        near = min(pts, key=lambda p: (km(lat, lon, p[1], p[2]), p[0]))
        assert got[i].is_same_bank == int(bool(own) and near[3] == bank)


def greedy(pts, radius):
    leaders, home = [], {}
    for p in sorted(pts, key=lambda p: (-p[4], p[0])):
        for q in leaders:
            if km(p[1], p[2], q[1], q[2]) <= radius:
                home[p[0]] = q[0]
                break
        else:
            leaders.append(p)
            home[p[0]] = p[0]
    return home


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_match_the_sequential_scan(spark, seed):
    pts, _, points, _ = world(spark, n=200, seed=seed)
    pts = pts + [(1000 + i, pts[0][1], pts[0][2], 0, 49) for i in range(5)]
    points = spark.createDataFrame(pts, "atm_id int, lat double, lon double, bank_id int, fraud_count int")
    assert {r.atm_id: r.leader_id for r in spatial.build_cells(points).collect()} == greedy(pts, 12.0)


def test_cell_names(spark):
    rows = [(1, 19.0, 72.8, 5, "", "A"), (2, 19.005, 72.8, 1, "Mumbai", "A"), (3, 28.6, 77.2, 9, "Delhi", "B"), (4, 12.97, 77.59, 2, "Bengaluru", "C"), (5, float("nan"), 77.0, 2, "x", "C")]
    points = spark.createDataFrame(rows, "atm_id int, lat double, lon double, fraud_count int, district string, state string")
    cells = {r.cell_id: r for r in spatial.describe_cells(points, spatial.build_cells(points)).collect()}
    assert sorted(cells) == ["CELL-001", "CELL-002", "CELL-003"]
    assert (cells["CELL-001"].atm_count, cells["CELL-001"].district) == (2, "Mumbai")
    assert cells["CELL-002"].district == "Bengaluru"  # equal sizes: smaller latitude first


def test_ranking_contract(spark):
    _, _, points, queries = world(spark)
    scored = choice.fixed_scores(queries, points.selectExpr("*", "double(fraud_count) / 100 as risk"))
    rows = {}
    for r in scored.collect():
        rows.setdefault((r.lat, r.lon, r.bank_id), []).append((r.choice_rank, r.score, r.p))
    for v in rows.values():
        v.sort()
        assert [r[0] for r in v] == list(range(1, len(v) + 1))
        assert all(a[1] >= b[1] for a, b in zip(v, v[1:]))
        assert abs(sum(r[2] for r in v) - 1) < 1e-9


def test_over_the_180th_meridian(spark):
    """Nearest, counts, circles and cells agree with all pairs for places on both sides, at a pole and across the equator."""
    import math
    import random

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    rng = random.Random(8)
    spot = lambda: (rng.uniform(-1, 1), rng.choice([1, -1]) * rng.uniform(179.6, 180.0))
    points = [spot() for _ in range(150)] + [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(20)]
    asks = [spot() for _ in range(20)] + [(89.5, 10.0), (0.0, 179.99)]
    machines = spark.createDataFrame([(i, *p, float(i % 7), 1) for i, p in enumerate(points)], "atm_id long, lat double, lon double, fraud_count double, risk int")
    places = spark.createDataFrame(asks, "lat double, lon double")
    near = {}
    for r in spatial.nearest_k(places, machines, 5).collect():
        near.setdefault((r.lat, r.lon), []).append((round(r.dist_km, 6), r.atm_id))
    counts = {(r.lat, r.lon): r.m for r in spatial.count_within(places, machines, 30.0, "m").collect()}
    circles = spark.createDataFrame([(*a, 10.0 + i * 3) for i, a in enumerate(asks)], "lat double, lon double, km double")
    circle = {(r.lat, r.lon): (r.km, r.m) for r in spatial.count_in_circles(circles, machines, "m").collect()}
    for a in asks:
        order = sorted((round(km(a, p), 6), i) for i, p in enumerate(points))
        assert [d for d, _ in sorted(near[a])] == [d for d, _ in order[:5]]
        assert counts[a] == sum(d <= 30.0 for d, _ in order)
        assert circle[a][1] == sum(d <= circle[a][0] for d, _ in order)
    leads, member = [], {}
    for i in sorted(range(len(points)), key=lambda i: (-float(i % 7), i)):
        home = next((j for j in leads if km(points[i], points[j]) <= 12.0), None)
        member[i] = i if home is None else home
        leads += [i] if home is None else []
    assert {r.atm_id: r.leader_id for r in spatial.build_cells(machines).collect()} == member
