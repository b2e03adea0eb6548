"""Numeric column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bits of a part of a number's fraction, and parts: whole number, then fractions.
PART_BITS, PARTS = 26, 4


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else NULL: NaN and infinities count as missing."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def exact_parts(x: Column) -> list[Column]:
    """``x`` as whole numbers p0, p1, ..: x = p0 + p1 / 2^26 + p2 / 2^52 + p3 / 2^78, all of the
    sign of ``x``; NULL where ``x`` is no finite number.

    Each step takes off the whole number and scales the rest by a power of two, which doubles do
    without error. Numbers from 2^-25 on are split without a rest; of smaller ones, less than
    2^-78 is left out.
    """
    rest, parts = finite(x.cast("double")), []
    for i in range(PARTS):
        part = rest.cast("bigint")
        parts.append(part)
        if i + 1 < PARTS:
            rest = (rest - part.cast("double")) * F.lit(float(1 << PART_BITS))
    return parts


def exact_sums(x: Column, name: str, weight: Column | None = None) -> list[Column]:
    """Aggregates ``{name}_0..`` of the parts of ``x``, times a whole ``weight``.

    Whole numbers add up alike in any order, so the sum does not depend on how rows are dealt.
    """
    return [F.sum(p if weight is None else p * weight).alias(f"{name}_{i}")
            for i, p in enumerate(exact_parts(x))]


def add_sums(name: str) -> list[Column]:
    """Aggregates that add up ``{name}_0..`` of several rows."""
    return [F.sum(f"{name}_{i}").alias(f"{name}_{i}") for i in range(PARTS)]


def exact_total(name: str, parts: list[Column] | None = None) -> Column:
    """The double nearest to the sum that ``{name}_0..`` hold, to the last bit or two."""
    parts = list(parts or [F.col(f"{name}_{i}") for i in range(PARTS)])
    for i in range(PARTS - 1, 0, -1):  # carry, so that every fraction is in [0, 2^26)
        carry = F.shiftright(parts[i], PART_BITS)
        parts[i] = parts[i] - F.shiftleft(carry, PART_BITS)
        parts[i - 1] = parts[i - 1] + carry
    high = (F.shiftleft(parts[1], PART_BITS) + parts[2]).cast("double")
    unit = F.lit(float(1 << PART_BITS))
    return parts[0].cast("double") + (high + parts[3].cast("double") / unit) / (unit * unit)


def round_half_up(x: Column, digits: int = 6) -> Column:
    """Round by ``floor(x * 10^d + 0.5)``; a ten-millionth more than a half, so that halves go up
    whatever their last bit is."""
    scale = F.lit(float(10 ** digits))
    return F.floor(x * scale + F.lit(0.5000001)).cast("double") / scale


def normalize_amount(amount: Column) -> Column:
    """Bucket a money amount into 0..50.

    NULL stays NULL, refunds and zero give 0, every started hundred counts one, 5000 and more 50.
    """
    # Bucket width 100, upper bound 5000, top bucket 50.
    return (F.when(amount <= 0, F.lit(0))
            .when(amount >= 5000, F.lit(50))
            .when(amount > 0, F.ceil(amount / 100))
            .cast("int"))


def cycle_of_year(year: Column) -> Column:
    """Election cycle of a calendar year: odd years belong to the next even one."""
    y = year.cast("bigint")
    return y + F.pmod(y, F.lit(2))


def lenient_bigint(text: Column) -> Column:
    """Text to bigint, NULL on failure; accepts decimals and exponents, rounding half away."""
    as_double = text.try_cast("double")
    rounded = F.when(as_double < 0, F.ceil(as_double - 0.5)).otherwise(F.floor(as_double + 0.5))
    in_range = F.abs(as_double) < F.lit(9.2e18)
    return F.coalesce(text.try_cast("bigint"),
                      F.when(in_range & ~F.isnan(as_double), rounded).cast("bigint"))


def zero_pad(code: Column, width: int = 4) -> Column:
    return F.lpad(code.cast("string"), width, "0")


def digits_to_int(text: Column) -> Column:
    """Strip everything but digits, then to int; NULL when nothing is left."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("int")
