"""Data-quality checks as result rows; warn or fail is the caller's choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


class CheckFailed(AssertionError):
    pass


def row_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule (``rules``: name -> condition that marks a bad row), in one pass."""
    one = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(name).alias("violations"))
        for name in rules])).alias("r")).select("r.*")


def set_check(name: str, violating_rows: DataFrame) -> DataFrame:
    """A check on derived rows (groups, keys): every row there is one violation."""
    return violating_rows.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("name"), "violations")


def report(checks: Sequence[DataFrame], severity: str = "warn") -> DataFrame:
    """(name, severity, violations, passed) for all checks."""
    rows = reduce(DataFrame.unionByName, checks)
    return rows.select("name", F.lit(severity).alias("severity"), "violations",
                       (F.col("violations") == 0).alias("passed"))


def enforce(result: DataFrame) -> DataFrame:
    """Fail mode: raise when a check did not pass. One row per check reaches the driver."""
    bad = result.where(~F.col("passed")).collect()
    if bad:
        raise CheckFailed("; ".join(f"{r['name']}: {r['violations']}" for r in bad))
    return result


def out_of_range(value: Column, low: float = -3, high: float = 3) -> Column:
    """Known values outside [low, high]; NULL is not an outlier."""
    return ~value.between(low, high)


def schema_problems(actual: StructType, expected: StructType) -> list[str]:
    """Missing or doubled columns and type differences."""
    have = [f.name for f in actual]
    out = [f"duplicate column {c}" for c in sorted({c for c in have if have.count(c) > 1})]
    types = {f.name: f.dataType for f in actual}
    for f in expected:
        if f.name not in types:
            out.append(f"missing column {f.name}")
        elif types[f.name] != f.dataType:
            out.append(f"column {f.name}: {types[f.name].simpleString()}"
                       f" instead of {f.dataType.simpleString()}")
    return out


def reconcile(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Row counts of source and output per key, and whether they agree."""
    a = source.groupBy(key).agg(F.count(F.lit(1)).alias("n_source"))
    b = output.groupBy(key).agg(F.count(F.lit(1)).alias("n_output"))
    j = a.join(b, key, "full")
    n_a, n_b = F.coalesce("n_source", F.lit(0)), F.coalesce("n_output", F.lit(0))
    return j.select(key, n_a.alias("n_source"), n_b.alias("n_output"),
                    (n_a == n_b).alias("complete"))


def crosswalk_checks(crosswalk: DataFrame, n_codes: int, n_12: int = 12,
                     max_49: int = 49) -> DataFrame:
    """Invariants of a crosswalk: one row per code, no NULL class, plausible industry counts."""
    one = crosswalk.agg(
        F.abs(F.count(F.lit(1)) - n_codes).alias("row_count"),
        F.count_if(F.col("ff12").isNull() | F.col("ff48").isNull() | F.col("ff49").isNull())
        .alias("null_class"),
        F.abs(F.count_distinct("ff12") - n_12).alias("industries_12"),
        F.greatest(F.count_distinct("ff49") - max_49, F.lit(0)).alias("industries_49"))
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("violations"))
        for c in one.columns])).alias("r")).select("r.*")
