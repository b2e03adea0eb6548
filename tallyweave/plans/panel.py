"""The two end-to-end plans: the donation panel and the processed contributor table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.text import contains_any, ENGINEER_WORDS, MANAGER_WORDS, occupation_class
from ..operators.crosswalk import attach_industry, is_tech_49
from ..operators.linkage import accepted, attach_matches, keep_accepted, match_names
from ..operators.quality import enforce, report
from ..operators.rows import sample_entities
from ..operators.scoring import CONTRIBUTION_TYPES, dynamic_score, local_means
from ..session import written
from ..sources.datasets import write_by_cycle

# The panel's cycles and the column order of the result.
TARGET_CYCLES = (2016, 2020, 2024)
PANEL_COLUMNS = (
    "bonica_cid", "cycle", "contributor_employer", "contributor_employer_matched",
    "contributor_occupation", "occupation_std", "ff49_name", "ff49_abbr", "ff12_name",
    "ff49_is_tech", "contributor_city", "contributor_zipcode", "contributor_cfscore",
    "contributor_gender", "cfscore_dyn_cycle", "mean_cfscore_per_city",
    "mean_cfscore_per_zipcode", "mean_dyn_cfscore_zipcode_cycle", "mean_dyn_cfscore_city_cycle")


def cycles_needed(targets: Sequence[int] = TARGET_CYCLES, step: int = 2) -> list[int]:
    """Target cycles and the one before each."""
    return sorted({c for t in targets for c in (t, t - step)})


def build_panel(contributions: DataFrame, register: DataFrame, crosswalk: DataFrame,
                targets: Sequence[int] = TARGET_CYCLES, sample: int | None = None,
                seed: int = 123, strict: float = 0.03, loose: float = 0.06,
                types: Sequence[str] = CONTRIBUTION_TYPES, only_listed: bool = True,
                engineer: Sequence[str] = ENGINEER_WORDS,
                manager: Sequence[str] = MANAGER_WORDS, grain: str = "donation") -> DataFrame:
    """Individuals' donations with accepted employer, industry, occupation, scores, local means.

    ``register`` comes from ``build_register``. ``grain="donor_cycle"`` keeps distinct rows.
    Means by place use the same place and cycle a row has. Linked and scored donations (accepted
    employers only, a small part of the source) are written to the shared folder, because scores,
    means and the panel read them again. The writes count their rows, and a join that multiplies
    donations stops the build.
    """
    c = contributions.where(F.col("cycle").isin(cycles_needed(targets)))
    if sample:
        c = sample_entities(c, "bonica_cid", sample, seed)
    c = c.where(F.col("contributor_type") == "I")
    matches = written(match_names(c, register, "contributor_employer", strict, loose,
                                  rows="n_rows"), "matches")
    names = accepted(matches).agg(F.sum("n_rows"), F.count("employer_raw")
                                  - F.count_distinct("employer_raw")).first()
    linked = keep_accepted(c, matches.drop("n_rows"), "contributor_employer")
    linked = attach_industry(linked, crosswalk, only_listed)
    linked = linked.select(
        "bonica_cid", "cycle", "transaction_type", "amount", "candidate_cfscore",
        "contributor_employer", F.col("matched_name").alias("contributor_employer_matched"),
        "contributor_occupation",
        occupation_class(F.col("contributor_occupation"), engineer, manager)
        .alias("occupation_std"),
        "ff49_name", "ff49_abbr", "ff12_name", is_tech_49(F.col("ff49_abbr"))
        .alias("ff49_is_tech"),
        "contributor_city", "contributor_zipcode", "contributor_cfscore", "contributor_gender")
    seen, carried, kept = Observation("linked"), Observation("carried"), Observation("scored")
    known = F.col("bonica_cid").isNotNull() & F.col("cycle").isNotNull()
    linked = written(linked.observe(seen, F.count(F.lit(1)).alias("n"),
                                    F.count_if(known).alias("n_known")), "linked")
    scores = dynamic_score(linked, types, donor="bonica_cid", score="candidate_cfscore",
                           carried=carried).select(
        "bonica_cid", "cycle", F.col("dynamic_score").alias("cfscore_dyn_cycle"))
    scored = written(linked.join(scores, ["bonica_cid", "cycle"]).observe(
        kept, F.count(F.lit(1)).alias("n")), "scored")
    _check_rows(spark=c.sparkSession, doubled=names[1], expected=names[0] or 0,
                linked=seen.get["n"], known=seen.get["n_known"],
                carried=carried.get["n_rows"] or 0, scored=kept.get["n"])
    panel = local_means(scored, {
        "mean_cfscore_per_city": ("contributor_cfscore", ["contributor_city"]),
        "mean_cfscore_per_zipcode": ("contributor_cfscore", ["contributor_zipcode"]),
        "mean_dyn_cfscore_city_cycle": ("cfscore_dyn_cycle", ["contributor_city", "cycle"]),
        "mean_dyn_cfscore_zipcode_cycle": ("cfscore_dyn_cycle",
                                           ["contributor_zipcode", "cycle"])})
    out = panel.select(*PANEL_COLUMNS)
    return out.distinct() if grain == "donor_cycle" else out


def _check_rows(spark: SparkSession, doubled: int, expected: int, linked: int, known: int,
                carried: int, scored: int) -> None:
    """Stop if a join has multiplied or lost donations: a name has one match, each donation with
    an accepted employer is linked once, counts twice in the scores (in its own cycle and the
    next), and has one score at most.

    The counts were taken by the writes themselves.
    """
    rows = [("employer names with more than one match", doubled),
            ("donations linked as often as their employer was accepted", abs(linked - expected)),
            ("donations carried into two cycles", abs(carried - 2 * known)),
            ("donations with more than one score", max(scored - known, 0))]
    enforce(report([spark.createDataFrame(rows, "name string, violations bigint")], "fail"))


def write_panel(panel: DataFrame, root: str) -> None:
    write_by_cycle(panel, root)


def process_contributors(contributors: DataFrame, register: DataFrame, crosswalk: DataFrame,
                         strict: float = 0.05, loose: float = 0.10,
                         engineer: Sequence[str] = ENGINEER_WORDS,
                         manager: Sequence[str] = MANAGER_WORDS) -> DataFrame:
    """One row per individual with an accepted employer: industry, occupation, local means.

    Means cover the kept rows. All crosswalk codes count, listed or not. Someone without an
    employer text has no status and is dropped with the unmatched.
    """
    emp, occ = "most_recent_contributor_employer", "most_recent_contributor_occupation"
    city, zip_ = "most_recent_contributor_city", "most_recent_contributor_zipcode"
    c = contributors.where((F.col("contributor_type") == "I") & F.col(emp).isNotNull())
    matches = written(match_names(c, register, emp, strict, loose), "matches")
    linked = attach_matches(c, matches, emp).where(
        (F.col("status") != "no_match") & (F.col("status") != "needs_review"))
    linked = attach_industry(linked, crosswalk, only_listed=False)
    eng, man = contains_any(F.col(occ), engineer), contains_any(F.col(occ), manager)
    linked = linked.select(
        "*", is_tech_49(F.col("ff49_abbr")).alias("ff49_is_tech"), eng.alias("engineer"),
        man.alias("manager"), (~eng & ~man & F.col(occ).isNotNull()).alias("other"),
        occupation_class(F.col(occ), engineer, manager).alias("occupation"))
    return local_means(written(linked, "linked"), {
        "mean_cfscore_per_city": ("contributor_cfscore", [city]),
        "mean_cfscore_per_zipcode": ("contributor_cfscore", [zip_])})
