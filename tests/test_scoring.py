import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.operators.scoring import (carry_forward, densify, dynamic_score,
                                          dynamic_score_framed, interpolate, local_means,
                                          multiplicity)

SCHEMA = ("donor_id bigint, cycle bigint, amount double, candidate_score double, "
          "transaction_type string")


def scores(df):
    return {(r["donor_id"], r["cycle"]): r["dynamic_score"] for r in df.collect()}


@pytest.mark.parametrize("f", [dynamic_score, dynamic_score_framed])
def test_two_cycles(spark, f):
    df = spark.createDataFrame([
        (1, 2014, 100.0, -1.0, "15"), (1, 2016, 300.0, 1.0, "15E"),
        (2, 2014, 50.0, 0.5, "15"), (2, 2016, -5.0, 0.9, "15"),
        (3, 2016, 50.0, 0.5, "22Y"), (None, 2016, 50.0, 0.5, "15")], SCHEMA)
    assert scores(f(df)) == {(1, 2014): -1.0, (1, 2016): 0.5, (2, 2014): 0.5, (2, 2016): 0.5}


def test_carried_cycles_on_request(spark):
    df = spark.createDataFrame([(1, 2014, 100.0, -1.0, "15")], SCHEMA)
    assert set(scores(dynamic_score(df, own_cycles_only=False))) == {(1, 2014), (1, 2016)}


def test_random_donations_with_a_hot_donor(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice([2012, 2014, 2016, 2020]),
             rng.uniform(-100, 7000), rng.uniform(-2, 2), rng.choice(["15", "24E", "x"]))
            for _ in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    num, den, own = defaultdict(float), defaultdict(float), set()
    for d, c, a, s, k in rows:
        own.add((d, c))
        w = 0 if a <= 0 else 50 if a >= 5000 else -(-a // 100)
        if k == "x" or not w:
            continue
        for cc in (c, c + 2):
            num[d, cc] += s * w
            den[d, cc] += w
    want = {k: num[k] / den[k] for k in num if k in own}
    for f in (dynamic_score, dynamic_score_framed):
        got = scores(f(df))
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        assert all(-2 <= v <= 2 for v in got.values())


def test_multiplicity(spark):
    df = spark.createDataFrame([("a", 2014), ("b", 2014), ("b", 2016)], "id string, cycle bigint")
    both = carry_forward(df)
    assert both.count() == 6
    assert [(r["id"], r["n"]) for r in multiplicity(both, "id", 2).collect()] == [("b", 4)]


def test_local_means(spark):
    df = spark.createDataFrame(
        [(1, None, 2014, 0.1), (2, None, 2014, 0.2), (3, "X", 2014, 0.2), (4, "X", 2016, 0.4),
         (5, "X", 2016, None), (6, "Y", 2016, None)],
        "id int, city string, cycle bigint, score double")
    out = local_means(df, {"by_city": ("score", ["city"]),
                           "by_city_cycle": ("score", ["city", "cycle"])})
    got = {r["id"]: (r["by_city"], r["by_city_cycle"]) for r in out.collect()}
    mean = (0.2 + 0.4) / 2  # doubles, summed without error: a little more than 0.3
    assert got == {1: (None, None), 2: (None, None), 3: (mean, 0.2), 4: (mean, 0.4),
                   5: (mean, 0.4), 6: (None, None)}


def test_interpolation(spark):
    df = spark.createDataFrame([(1, 2012, 0.0), (1, 2018, 3.0), (2, 2014, 5.0), (3, 2014, None)],
                               "id int, cycle bigint, s double")
    out = interpolate(densify(df, "id", range(2010, 2021, 2)), "id", "s")
    got = defaultdict(dict)
    for r in out.collect():
        got[r["id"]][r["cycle"]] = r["interpolated"]
    assert got[1] == {2010: 0.0, 2012: 0.0, 2014: 1.0, 2016: 2.0, 2018: 3.0, 2020: 3.0}
    assert set(got[2].values()) == {5.0} and len(got[2]) == 6
    assert 3 not in got


def test_plan_sums_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2014, 1.0, 1.0, "15")], SCHEMA)
    plan = dynamic_score(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Window" not in plan
    assert F.col("x") is not None
