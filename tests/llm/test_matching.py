"""Nearest-time matching and surviving picks against brute force, with odd input and many partitions."""

import random
from datetime import datetime, timedelta

import pytest

from fieldwatch.llm.nearest import nearest_in_time
from fieldwatch.llm.survivors import pick_groups, pick_key, pick_time_us

T0 = datetime(1998, 1, 1)
ROW = "id long, entity string, ts timestamp_ntz, us string"  # a further column with a name used inside


def frame(spark, rows):
    return spark.createDataFrame([(i, e, None if t is None else T0 + timedelta(microseconds=t), "x") for i, e, t in rows], ROW)


@pytest.mark.parametrize("target, seed", [(25, 1), (200, 2), (10**6, 3)])
def test_nearest_equals_brute_force(spark, target, seed):
    rnd = random.Random(seed)
    right = [(i, rnd.choice("aaab"), rnd.randrange(0, 60_000) * 10_000) for i in range(400)]
    right += [(1000 + i, "a", 300_000_000) for i in range(200)]  # a third are copies of one moment
    left = [(i, rnd.choice("aabc"), rnd.randrange(0, 60_000) * 10_000) for i in range(150)] + [(500, "a", 300_000_000), (500, "a", 300_000_000), (501, None, 1), (502, "a", None), (503, "z", 5)]
    got = sorted((r.left_id, r.right_id) for r in nearest_in_time(frame(spark, left), frame(spark, right + [(7777, None, 5), (7778, "a", None)]), 3.0, target).collect())
    got = [(i, -1 if r is None else r) for i, r in ((a, b) for a, b in sorted(got, key=lambda x: (x[0], -1 if x[1] is None else x[1])))]
    want = []
    for i, e, t in left:
        near = [(abs(u - t), j) for j, f, u in right if f == e and t is not None and abs(u - t) <= 3_000_000]
        want.append((i, min(near)[1] if near else -1))
    assert got == sorted(want)


def test_nearest_of_nothing(spark):
    some, none = frame(spark, [(1, "a", 0)]), frame(spark, [])
    assert nearest_in_time(none, some, 1).count() == 0
    assert [tuple(r) for r in nearest_in_time(some, none, 1).collect()] == [(1, None, None)]


def test_an_entity_over_many_partitions_without_right_rows_in_most(spark):
    left = [(i, "a", i * 1_000_000) for i in range(300)]
    right = [(900, "a", 0), (901, "a", 299_000_000)]
    got = {r.left_id: r.right_id for r in nearest_in_time(frame(spark, left), frame(spark, right), 1e9, 20).collect()}
    assert got == {i: 900 if i <= 149 else 901 for i in range(300)}


PICK = "pick_id long, phase string, time string, probability double, model string, trace_id string, review string, received_at timestamp_ntz, rank string"


def test_time_and_key_forms(spark):
    from pyspark.sql import functions as F

    forms = ["1998-01-01T00:01:04.784177Z", "1998-01-01 00:01:04.784177", "1998-01-01T02:01:04.784177+02:00", "1997-12-31T16:01:04.784177-08:00", "883612864.784177", "19980101T000104.784177Z", " 1998-01-01t00:01:04.784177z "]
    got = spark.createDataFrame([(t,) for t in forms], "t string").select(pick_time_us(F.col("t"))).collect()
    assert {r[0] for r in got} == {883612864784177}
    assert spark.createDataFrame([("soon",), ("",), (None,), ("1998-13-01T00:00:00Z",)], "t string").select(pick_time_us(F.col("t")).alias("x")).where("x is not null").count() == 0
    keys = [("XE.NBGO.00", "S"), (" xe_nbgo_00 ", "s-wave"), ("XE.NBGO.00.BHZ", "S "), ("VX.U.--", "p"), ("VX.U.", "P-wave"), ("VX.U..BHE", "P"), ("VX", "P"), ("VX.U.", "Pg")]
    rows = spark.createDataFrame(keys, "a string, b string").select(*pick_key(F.col("a"), F.col("b"))).collect()
    assert {tuple(r) for r in rows[:3]} == {("XE", "NBGO", "00", "S")} and {tuple(r) for r in rows[3:6]} == {("VX", "U", "", "P")}
    assert rows[6].network is None and rows[7].wave is None


def brute_groups(rows):
    out = []
    keys = {(r[5], r[1]) for r in rows}
    for key in keys:
        mine = sorted((r for r in rows if (r[5], r[1]) == key), key=lambda r: r[-1])
        chain = []
        for r in mine:
            if chain and r[-1] - chain[-1][-1] > 1_000_000:
                out.append(chain)
                chain = []
            chain.append(r)
        out.append(chain)
    best = lambda c: min(c, key=lambda r: (r[6] != "manual", -((r[3] is not None) + (r[4] is not None)), -r[7].timestamp() if r[7] else 1e18, r[0]))
    return sorted((best(c)[0], len(c)) for c in out)


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        us = rnd.choice([3_599_000_000, 7_199_500_000, 10_000_000]) + rnd.randrange(0, 60) * 250_000  # chains over the borders of cells
        rows.append((i, rnd.choice("PS"), None, rnd.choice([None, 0.5]), rnd.choice([None, "m"]), rnd.choice(["A.B.", "A.C.10"]), rnd.choice([None, "manual", "automatic"]), rnd.choice([None, T0 + timedelta(seconds=rnd.randrange(3))]), us))
    data = [(*r[:2], f"{r[8] / 1e6:.6f}", *r[3:8], "x") for r in rows]
    data += [(9000, None, "1.0", 0.1, "m", "A.B.", None, None, "x"), (9001, "P", None, 0.1, "m", "A.B.", None, None, "x"), (9002, "P", "1.0", 0.1, "m", None, None, None, "x")]
    got = sorted((r.pick_id, r.picks) for r in pick_groups(spark.createDataFrame(data, PICK)).collect())
    assert got == brute_groups(rows)
    assert pick_groups(spark.createDataFrame([], PICK)).count() == 0


def test_a_chain_over_many_cells_is_one_group(spark):
    data = [(i, "P", f"{i * 0.9:.6f}", None, None, "A.B.", None, None, "x") for i in range(9000)]
    got = pick_groups(spark.createDataFrame(data, PICK)).collect()
    assert [(r.pick_id, r.picks) for r in got] == [(0, 9000)]
