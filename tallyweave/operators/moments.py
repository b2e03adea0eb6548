"""Cross-product sums of a model's columns, in one pass over the rows.

Rows are first summed per combination of factor levels. Every combination then contributes to the
few cross products its own dummies and the numeric columns take part in, so nothing of the width
of the design matrix is ever built per row. What reaches the driver is (terms)^2 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType

INTERCEPT = "(Intercept)"
Y = "(y)"
#: Sums of products that reach the driver at most: those of a thousand terms.
MAX_ENTRIES = 500_000


@dataclass
class Terms:
    """Right-hand side of a formula, split by the kind of column."""

    factors: list[str] = field(default_factory=list)
    numerics: list[str] = field(default_factory=list)
    crossed: list[tuple[str, str]] = field(default_factory=list)
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.factors, *self.numerics]

    def level_names(self, factor: str, names: set[str]) -> list[str]:
        """Dummies of a factor among ``names``: in the order given for it, the rest as text."""
        rank = {f"{factor}[{level}]": i for i, level in enumerate(self.levels.get(factor, ()))}
        own = [n for n in names if n.startswith(f"{factor}[") and "]:" not in n]
        return sorted(own, key=lambda n: (rank.get(n, len(rank)), n))


def read_terms(df: DataFrame, terms: Sequence[str],
               levels: dict[str, Sequence[str]] | None = None) -> Terms:
    """``["a", "x", "a*b"]``: text and boolean columns are factors, ``*`` adds the interaction.

    ``levels`` orders the levels of a factor; the first that occurs is the base.
    """
    out = Terms(levels={f: tuple(map(str, own)) for f, own in (levels or {}).items()})
    for term in terms:
        names = [t.strip() for t in term.split("*")]
        for n in names:
            factor = isinstance(df.schema[n].dataType, (StringType, BooleanType))
            target = out.factors if factor else out.numerics
            if n not in target:
                target.append(n)
        if len(names) == 2:
            if not all(n in out.factors for n in names):
                raise ValueError(f"interaction {term} needs two factors")
            out.crossed.append((names[0], names[1]))
    return out


def cross_products(df: DataFrame, y: str, terms: Terms, by: Sequence[str] = ()) -> DataFrame:
    """(by..., a, b, v): sums of products of every two columns of the model, y included.

    All factor levels are present; the caller leaves out the base levels. Rows with a NULL in any
    model column are left out.
    """
    by = list(by)
    num = [*terms.numerics, y]
    data = df.dropna(subset=list(dict.fromkeys([*terms.columns, y])))
    sums = [F.count(F.lit(1)).cast("double").alias("_n")]
    x = {c: F.col(c).cast("double") for c in num}
    for i, c in enumerate(num):
        sums.append(F.sum(x[c]).alias(f"_s{i}"))
        for j in range(i, len(num)):
            sums.append(F.sum(x[c] * x[num[j]]).alias(f"_p{i}_{j}"))
    keys = list(dict.fromkeys([*by, *terms.factors]))
    cells = data.groupBy(*keys).agg(*sums) if keys else data.agg(*sums)

    def level(f: str):
        return F.concat(F.lit(f"{f}["), F.col(f).cast("string"), F.lit("]"))

    dummies = [F.lit(INTERCEPT), *[level(f) for f in terms.factors],
               *[F.concat(level(a), F.lit(":"), level(b)) for a, b in terms.crossed]]
    names = [F.lit(Y if c == y else c) for c in num]
    entries = [(a, b, F.col("_n")) for a, b in combinations_with_replacement(dummies, 2)]
    entries += [(d, names[i], F.col(f"_s{i}")) for d in dummies for i in range(len(num))]
    entries += [(names[i], names[j], F.col(f"_p{i}_{j}"))
                for i in range(len(num)) for j in range(i, len(num))]
    rows = cells.select(*by, F.explode(F.array(*[
        F.struct(a.alias("a"), b.alias("b"), v.alias("v")) for a, b, v in entries])).alias("e"))
    return (rows.select(*by, "e.a", "e.b", "e.v").groupBy(*by, "a", "b")
            .agg(F.sum("v").alias("v")))


def collect_bounded(df: DataFrame, what: str, limit: int = MAX_ENTRIES) -> list:
    """Collect a small result; refuse, rather than cut, one that is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} entries, too many levels to solve")
    return rows


def ordered_terms(names: set[str], terms: Terms) -> list[str]:
    """Column order of the model: intercept, factors in level order, numerics, interactions.

    The first level of each factor is the base and left out, also inside interactions.
    """
    base = {}
    out = [INTERCEPT]
    for f in terms.factors:
        levels = terms.level_names(f, names)
        base[f] = levels[0] if levels else None
        out += levels[1:]
    out += [c for c in terms.numerics]
    for a, b in terms.crossed:
        for n in sorted(n for n in names if n.startswith(f"{a}[") and f"]:{b}[" in n):
            left, right = n.split("]:", 1)
            if left + "]" != base[a] and right != base[b]:
                out.append(n)
    return out


def as_matrix(entries: dict[tuple[str, str], float], order: Sequence[str]) -> np.ndarray:
    pos = {c: i for i, c in enumerate(order)}
    m = np.zeros((len(order), len(order)))
    for (a, b), v in entries.items():
        if a in pos and b in pos:
            m[pos[a], pos[b]] = m[pos[b], pos[a]] = v
    return m
