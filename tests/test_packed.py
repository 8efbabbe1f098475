import itertools
import random

from pyspark.sql import functions as F

from cashtrail.operators import candidates, nearness
from cashtrail.operators.packed import Accounts, Packed


def test_lists_hold_every_pair_once_and_count_them(spark):
    rows = [(1, 5), (1, 5), (5, 1), (9, 1), (9, 7)]
    packed = Packed(spark.createDataFrame(rows, "t int, s int").repartition(4))
    assert packed.n == 4 and {(r.t, r.n) for r in packed.degrees().collect()} == {(1, 1), (5, 1), (9, 2)}
    far = Accounts(spark.createDataFrame([(7,), (10**15,), (None,)], "account_id long"), 3)
    named = far.named(far.number(spark.createDataFrame([(10**15,), (None,)], "x long"), account="x"))
    assert far.size == 2 and {r.account_id for r in named.collect()} == {10**15, None}


def test_crews_are_summed_in_many_tasks_without_writing_pairs(spark, monkeypatch):
    """Before, all links went to every row of a grid and every (account, past user) pair was written and joined."""
    monkeypatch.setattr(nearness, "ASKED_A_TASK", 20)
    rnd = random.Random(5)
    moves = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(75)] + [(3, 3), (None, 4), (4, None)]
    near = {}
    for a, b in moves:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def ball(a):
        seen = {a}
        for _ in range(3):
            seen |= set(itertools.chain.from_iterable(near.get(x, ()) for x in seen))
        return seen

    past = [(b, m, 1 + b % 3) for b in range(0, 90, 2) for m in (0, 1 + b % 4)]
    asked = [(a, m) for a in range(90) for m in range(3)]
    want = {(a, m): sum(n for b, mm, n in past if mm == m and b in ball(a)) for a, m in asked}
    monkeypatch.setattr(candidates, "within_three", None)
    found = candidates.crew_prior(spark.createDataFrame(asked + asked[:9] + [(None, 1), (1, None)], "account_id long, atm_id long"),
                                  spark.createDataFrame(moves, "src_account long, dst_account long"), spark.createDataFrame(past, "account_id long, atm_id long, n long"))
    assert sorted(tuple(r) for r in found.select("account_id", "atm_id", "crew_prior").collect()) == sorted((a, m, n) for (a, m), n in want.items() if n)
    assert found.filter(F.col("account_id").isNull()).isEmpty()
