"""Amount-weighted scores per entity and cycle, local means, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..functions.numeric import (PARTS, add_sums, exact_parts, exact_sums, exact_total, finite,
                                 normalize_amount)
from .joins import null_safe_join

# Transaction types that count as contributions.
CONTRIBUTION_TYPES = ("15", "15E", "15J", "15S", "15L", "24E", "24P")


def carry_forward(df: DataFrame, cycle: str = "cycle", step: int = 2) -> DataFrame:
    """Every row once in its own cycle and once in the next (union of shifted and original)."""
    return df.withColumn(cycle, F.explode(F.array(F.col(cycle), F.col(cycle) + step)))


def multiplicity(df: DataFrame, key: str, expected: int) -> DataFrame:
    """Keys that do not occur exactly ``expected`` times."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def cycle_sums(donations: DataFrame, types: Sequence[str] = CONTRIBUTION_TYPES,
               donor: str = "donor_id", cycle: str = "cycle", amount: str = "amount",
               score: str = "candidate_score", kind: str = "transaction_type") -> DataFrame:
    """``weight`` and the parts of the weighted score sum (``_s_0..``) per donor and cycle.

    ``donations`` may be a stream: these are its running sums.
    """
    weight = normalize_amount(finite(F.col(amount).cast("double")))
    ok = finite(F.col(score).cast("double")).isNotNull() & weight.isNotNull() & F.col(kind).isin(*types)
    w = F.when(ok, weight).otherwise(F.lit(0)).cast("bigint")
    return (donations.where(F.col(donor).isNotNull() & F.col(cycle).isNotNull())
            .select(donor, cycle, w.alias("_w"),
                    F.when(ok, F.col(score)).otherwise(F.lit(0.0)).alias("_x"))
            .groupBy(donor, cycle)
            .agg(*exact_sums(F.col("_x"), "_s", F.col("_w")), F.sum("_w").alias("weight"),
                 F.count(F.lit(1)).alias("_rows")))


def cycle_totals(donations: DataFrame, types: Sequence[str] = CONTRIBUTION_TYPES,
                 donor: str = "donor_id", cycle: str = "cycle", **cols: str) -> DataFrame:
    """Weighted score sum and weight per donor and cycle, for donors' own cycles.

    A donation that does not qualify adds weight 0, so its cycle is still known as an own one; a
    score or amount that is no finite number is missing.
    """
    return cycle_sums(donations, types, donor, cycle, **cols).select(
        donor, cycle, exact_total("_s").alias("weighted_sum"), "weight")


def dynamic_score(donations: DataFrame, types: Sequence[str] = CONTRIBUTION_TYPES,
                  donor: str = "donor_id", cycle: str = "cycle", step: int = 2,
                  own_cycles_only: bool = True, carried: Observation | None = None,
                  **cols: str) -> DataFrame:
    """Score per donor and cycle over the cycle itself and the one before.

    score = sum(candidate score * bucketed amount) / sum(bucketed amount). Donations are summed
    per (donor, cycle) first, so what is carried into the next cycle is one row per donor-cycle,
    however many donations a donor made. ``own_cycles_only`` keeps cycles with an own donation,
    qualified or not. Sums are exact (see ``exact_parts``), whatever the order, and good for 2e9
    donations of one donor in one cycle before ANSI overflow stops the job. ``carried`` observes
    ``n_rows``, the donations counted in their own cycle and in the next.
    """
    return scores_of_sums(cycle_sums(donations, types, donor, cycle, **cols), donor, cycle, step,
                          own_cycles_only, carried)


def scores_of_sums(own: DataFrame, donor: str = "donor_id", cycle: str = "cycle", step: int = 2,
                   own_cycles_only: bool = True, carried: Observation | None = None) -> DataFrame:
    """Scores from what ``cycle_sums`` returns, each row counted in its own cycle and the next."""
    both = (own.withColumn("_own", F.explode(F.array(F.lit(1), F.lit(0))))
            .withColumn(cycle, F.when(F.col("_own") == 1, F.col(cycle))
                        .otherwise(F.col(cycle) + step)))
    if carried is not None:
        both = both.observe(carried, F.sum("_rows").alias("n_rows"))
    out = (both.groupBy(donor, cycle)
           .agg(*add_sums("_s"), F.sum("weight").alias("weight"), F.max("_own").alias("_own"))
           .where(F.col("weight") > 0))
    if own_cycles_only:
        out = out.where(F.col("_own") == 1)
    return _with_score(out).select(donor, cycle, "weighted_sum", "weight", "dynamic_score")


def dynamic_score_framed(donations: DataFrame, types: Sequence[str] = CONTRIBUTION_TYPES,
                         donor: str = "donor_id", cycle: str = "cycle", step: int = 2,
                         **cols: str) -> DataFrame:
    """Same result as :func:`dynamic_score` with a trailing RANGE frame.

    The window runs over donor-cycle totals (one row per cycle), never over donations.
    """
    own = cycle_sums(donations, types, donor, cycle, **cols)
    frame = Window.partitionBy(donor).orderBy(cycle).rangeBetween(-step, 0)
    out = own.select(donor, cycle, F.sum("weight").over(frame).alias("weight"),
                     *[F.sum(f"_s_{i}").over(frame).alias(f"_s_{i}") for i in range(PARTS)]
                     ).where(F.col("weight") > 0)
    return _with_score(out).select(donor, cycle, "weighted_sum", "weight", "dynamic_score")


def _with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("weighted_sum", exact_total("_s")).withColumn(
        "dynamic_score", F.col("weighted_sum") / F.col("weight").cast("double"))


def group_means(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Mean per group by exact sums; NULL values are skipped, NULL keys form a group."""
    sums = df.groupBy(*keys).agg(*exact_sums(F.col(value), "_s"),
                                 F.count(finite(F.col(value).cast("double"))).alias("_n"))
    return sums.select(*keys, F.try_divide(exact_total("_s"), F.col("_n").cast("double"))
                       .alias(name))


def local_means(df: DataFrame, means: dict[str, tuple[str, Sequence[str]]],
                base: DataFrame | None = None) -> DataFrame:
    """Attach group means to rows: ``{new column: (value column, key columns)}``.

    One pass sums every value per cell (all keys together); each mean is a window over those
    cells; one null-safe join brings all of them back. A place that holds a third of the rows is
    a few cells by then. A NULL key gives a NULL mean. ``base`` computes the means from other
    rows than the ones they are attached to. ``df`` is read twice: pass a written table where
    computing it is expensive.
    """
    keys = list(dict.fromkeys(k for _, ks in means.values() for k in ks))
    values = list(dict.fromkeys(v for v, _ in means.values()))
    src = df if base is None else base
    aggs = []
    for i, v in enumerate(values):
        aggs += [*exact_sums(F.col(v), f"_s{i}"),
                 F.count(exact_parts(F.col(v))[0]).alias(f"_c{i}")]
    cells = src.groupBy(*keys).agg(*aggs)
    out = list(keys)
    for name, (v, ks) in means.items():
        i = values.index(v)
        w = Window.partitionBy(*ks)
        total = exact_total("", [F.sum(f"_s{i}_{p}").over(w) for p in range(PARTS)])
        count = F.sum(f"_c{i}").over(w).cast("double")
        known = F.lit(True)
        for k in ks:
            known = known & F.col(k).isNotNull()
        out.append(F.when(known & (count > 0), total / count).alias(name))
    return null_safe_join(df, cells.select(*out), keys, "left")


def densify(scores: DataFrame, entity: str, cycles: Sequence[int],
            cycle: str = "cycle") -> DataFrame:
    """One row per entity and listed cycle, NULL where there was none."""
    ids = scores.select(entity).distinct()
    grid = ids.withColumn(cycle, F.explode(F.array(*[F.lit(int(c)).cast("bigint")
                                                     for c in cycles])))
    return grid.join(scores, [entity, cycle], "left")


def interpolate(dense: DataFrame, entity: str, value: str, cycle: str = "cycle",
                out: str = "interpolated") -> DataFrame:
    """Linear interpolation between known cycles, flat beyond the ends.

    Entities without any known value are dropped. Windows span the cycles of one entity.
    """
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(cycle).alias("c"),
                                                      F.col(value).alias("v")))
    w = Window.partitionBy(entity).orderBy(cycle)
    prev = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = dense.withColumn("_p", prev).withColumn("_q", nxt)
    p, q = F.col("_p"), F.col("_q")
    between = p["v"] + (q["v"] - p["v"]) * (F.col(cycle) - p["c"]).cast("double") \
        / (q["c"] - p["c"]).cast("double")
    filled = (F.when(p.isNull(), q["v"]).when(q.isNull(), p["v"])
              .when(p["c"] == q["c"], p["v"]).otherwise(between))
    return (d.withColumn(out, filled).where(F.col(out).isNotNull()).drop("_p", "_q"))
