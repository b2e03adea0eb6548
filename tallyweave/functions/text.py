"""Text column expressions: name normalisation and word-list classes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Legal-form words dropped from company names.
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company",
               "llc", "llp", "ltd", "limited", "plc", "lp")

# Occupation word lists; managers win over engineers.
ENGINEER_WORDS = ("engineer", "data scientist")
MANAGER_WORDS = ("manager", "ceo", "cfo", "president", "director")


def squish(text: Column) -> Column:
    """Trim and collapse runs of white space, no-break and other Unicode spaces included."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def normalize_name(text: Column, drop: Sequence[str] = LEGAL_FORMS) -> Column:
    """Lower-case, punctuation and any white space to one space, legal-form words out.

    Words are compared as whole tokens, so the result does not hang on an engine's idea of ``\\b``.
    """
    spaced = F.regexp_replace(F.lower(text), r"[\p{P}\p{Z}\s]+", " ")
    # Every token now stands between single spaces; a dropped one takes its left space along.
    pattern = " (?:" + "|".join(re.escape(w) for w in drop) + ")(?= )"
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), pattern, ""))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-sensitive substring test against a word list; NULL text gives NULL."""
    return text.rlike("|".join(re.escape(w) for w in words))


def occupation_class(text: Column, engineer: Sequence[str] = ENGINEER_WORDS,
                     manager: Sequence[str] = MANAGER_WORDS) -> Column:
    """'manager', 'engineer' or 'other'; NULL stays NULL."""
    return (F.when(contains_any(text, manager), "manager")
            .when(contains_any(text, engineer), "engineer")
            .when(text.isNotNull(), "other"))


def non_empty(text: Column) -> Column:
    return F.length(text) > 0
