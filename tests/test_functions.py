import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.functions.jaro import jaro_batch, jaro_distance
from tallyweave.functions.numeric import (add_sums, cycle_of_year, digits_to_int, exact_parts,
                                          exact_sums, exact_total, finite,
                                          lenient_bigint, normalize_amount, zero_pad)
from tallyweave.functions.tails import chi2_upper, f_upper, t_two_sided
from tallyweave.functions.text import normalize_name, occupation_class, squish


def column(df, expr):
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def one(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1)


def test_amount_buckets(spark):
    df = one(spark, [None, -5.0, 0.0, 0.01, 100.0, 100.01, 4999.99, 5000.0, 1e9], "double")
    assert column(df, normalize_amount(F.col("v"))) == [None, 0, 0, 1, 1, 2, 50, 50, 50]


def test_values_that_are_no_finite_number_are_missing(spark):
    df = one(spark, [0.5, float("nan"), float("inf"), None], "double")
    assert column(df, exact_parts(F.col("v"))[1]) == [1 << 25, None, None, None]
    assert column(df, finite(F.col("v"))) == [0.5, None, None, None]


def test_sums_are_exact_in_any_order(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-6, 9) for _ in range(3000)]
    values += [0.1] * 10 + [-0.1] * 7 + [1e15, -1e15, 2.0 ** -25, -0.0, 123456789.000000123]
    want = [math.fsum(values), math.fsum(3 * v for v in values)]
    for parts in (1, 7):
        df = spark.createDataFrame([(v, 3) for v in values], "v double, w int").repartition(parts)
        one = df.groupBy(F.spark_partition_id().alias("p")).agg(
            *exact_sums(F.col("v"), "a"), *exact_sums(F.col("v"), "b", F.col("w")))
        got = one.agg(*add_sums("a"), *add_sums("b")).select(
            exact_total("a").alias("a"), exact_total("b").alias("b")).first()
        assert got["a"] == pytest.approx(want[0], rel=1e-15)
        assert Fraction(got["b"]) == pytest.approx(sum(3 * Fraction(v) for v in values), rel=1e-15)


def test_unicode_spaces(spark):
    df = one(spark, ["ACME\u00a0INC", "\u2003Acme\u3000Co. ", "acme"], "string")
    assert column(df, normalize_name(F.col("v"))) == ["acme"] * 3
    assert column(df, squish(F.col("v"))) == ["ACME INC", "Acme Co.", "acme"]


def test_lenient_bigint(spark):
    df = one(spark, ["12.5", "1e3", " 7 ", "x", "", "-2.5", "NaN", "1e30", None], "string")
    assert column(df, lenient_bigint(F.col("v"))) == [13, 1000, 7, None, None, -3, None, None,
                                                      None]


def test_codes(spark):
    df = one(spark, ["SIC 0100", "73-72", "none"], "string")
    assert column(df, digits_to_int(F.col("v"))) == [100, 7372, None]
    assert column(one(spark, [100, 7372], "int"), zero_pad(F.col("v"))) == ["0100", "7372"]
    assert column(one(spark, [2015, 2016], "int"), cycle_of_year(F.col("v"))) == [2016, 2016]


def test_names(spark):
    df = one(spark, ["AT&T Co., Inc.", "The  Company LLC", "coé", "$5+x", "...", None,
                     "co co inc corp", "Costco"], "string")
    assert column(df, normalize_name(F.col("v"))) == [
        "at t", "the", "coé", "$5+x", "", None, "", "costco"]


def test_occupations(spark):
    df = one(spark, ["project manager", "software engineer", "engineering director", "teacher",
                     None, "President", "vice president"], "string")
    assert column(df, occupation_class(F.col("v"))) == [
        "manager", "engineer", "manager", "other", None, "other", "manager"]


def plain_jaro(a, b):
    """Textbook definition, one pair at a time."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(a)
    right = []
    for j, ch in enumerate(b):
        for i in range(max(0, j - reach), min(len(a), j + reach + 1)):
            if not used[i] and a[i] == ch:
                used[i] = True
                right.append(ch)
                break
    m = len(right)
    if not m:
        return 0.0
    left = [c for c, u in zip(a, used) if u]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12)),
                min_size=1, max_size=20))
def test_jaro_batch_equals_definition(pairs):
    got = jaro_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [plain_jaro(a, b) for a, b in pairs]


def test_jaro_column(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("same", "same"), (None, "x"), ("é", "è")],
                               "a string, b string").coalesce(1)
    d = column(df, jaro_distance(F.col("a"), F.col("b")))
    assert d[0] == pytest.approx(1 - 0.944444, abs=1e-5)
    assert d[1:] == [0.0, None, 1.0]


def test_distribution_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert f_upper(3.0, 2, 20) == pytest.approx(0.07253815, abs=1e-7)
    assert chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(40.0, 5) == pytest.approx(1.4939e-07, rel=1e-3)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert math.isclose(f_upper(4.0, 1, 10), t_two_sided(2.0, 10), rel_tol=1e-12)


def test_jaro_batch_around_64_characters():
    rng = random.Random(4)
    left = ["".join(rng.choice("abcé漢") for _ in range(rng.randint(55, 70))) for _ in range(600)]
    right = [a[::-1] if rng.random() < 0.2 else a[rng.randint(0, 3):] + rng.choice(["", "b", "ca"])
             for a in left]
    assert list(jaro_batch(left, right)) == [plain_jaro(a, b) for a, b in zip(left, right)]
