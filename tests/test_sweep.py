"""Sweeps and threshold choices against direct evaluation; the sufficiency gate."""

import random

from fieldwatch.operators import sweep as sw


def test_threshold_table_counts(spark):
    rnd = random.Random(0)
    rows = [(round(rnd.random(), 3), rnd.random() < 0.3) for _ in range(500)] + [(None, True)]
    df = spark.createDataFrame(rows, "p double, y boolean")
    cuts = [0.0, 0.25, 0.5, 0.5, 0.9, 1.1]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in sw.threshold_table(df.where("p is not null"), cuts).collect()}
    for t in set(cuts):
        c = [(p >= t, y) for p, y in rows if p is not None]
        assert got[t] == (c.count((True, True)), c.count((True, False)), c.count((False, True)), c.count((False, False)))


def test_choice_of_nothing_feasible(spark):
    df = spark.createDataFrame([(0.9, False), (0.8, True), (0.1, False)], "p double, y boolean")
    r = sw.choose(sw.threshold_table(df, [0.05, 0.5, 0.85])).first()
    assert (r.threshold, r.method) == (0.5, "fallback")


def test_sweep_counts_like_single_runs(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice([None, rnd.random() * 900]), rnd.choice([None, 0, 1, 2, 3, 4])) for _ in range(400)]
    df = spark.createDataFrame(rows, "station string, amp double, gl int")
    grid = sw.grid([50, 100], [200], [600])
    got = {(r.minor, r.station): r for r in sw.sweep(df, "station", grid, [50, 100, 200, 600], 20.0, 30.0).collect()}
    for minor in (50.0, 100.0):
        for s in "ab":
            lev = lambda a: None if a is None else 4 if a >= 200 else 3 if a >= minor else 2 if a >= 30 else 1 if a >= 20 else 0
            mine = [(lev(a), g) for t, a, g in rows if t == s]
            storm = [x for x, g in mine if g is not None and g >= 3]
            assert got[minor, s].sdr == sum(x is not None and x >= 3 for x in storm) / len(storm)
            both = [abs(x - g) for x, g in mine if x is not None and g is not None]
            assert abs(got[minor, s].mae - sum(both) / len(both)) < 1e-12


def test_sufficiency(spark):
    full = [(o, y, c) for o in "ab" for y in (2020, 2021) for c in ("quiet", "storm") for _ in range(4)]
    gate = lambda rows: sw.pooled_sufficiency(spark.createDataFrame(rows, "observatory string, year int, class_name string"), ["quiet", "storm"]).first().sufficient
    assert gate(full) and not gate(full[1:]) and not gate([]) and not gate(full + [("c", 2020, "quiet")]) and not gate([x for x in full if x[2] == "quiet"])
