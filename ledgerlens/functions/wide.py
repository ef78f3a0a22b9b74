"""Whole amounts of up to 256 bits as structs of three decimals, for sums and comparisons beyond 38 digits.

value = high * 10^52 + middle * 10^26 + low, with middle and low below 10^26. In this form structs compare like the
numbers, so `max`, `min`, ordering and joins work on them directly. Amounts are not negative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L

LIMB_DIGITS = 26
WIDE_DIGITS = 3 * LIMB_DIGITS
WIDE = "struct<high: decimal(38,0), middle: decimal(28,0), low: decimal(28,0)>"
LARGEST = 2**256 - 1
HEX_GROUP = 8


def _decimal(number: int, kind: str = "decimal(27,0)") -> Column:
    return F.lit(str(number)).cast(kind)


def _limbs_of(number: int) -> tuple[int, int, int]:
    base = 10**LIMB_DIGITS
    return number // base**2, number // base % base, number % base


def _carried(high: Column, middle: Column, low: Column) -> Column:
    """Limbs of up to 38 digits each, with what exceeds a limb moved to the next one."""
    base = _decimal(10**LIMB_DIGITS)

    def over(c: Column) -> Column:
        # at most 12 digits, so the whole-number quotient fits 64 bits
        return F.call_function("div", c, base).cast("decimal(13,0)")

    middle = (middle + over(low)).cast(L.WEI)
    return F.struct(
        (high + over(middle)).cast(L.WEI).alias("high"),
        (middle % base).cast("decimal(28,0)").alias("middle"),
        (low % base).cast("decimal(28,0)").alias("low"),
    )


def _from_digits(digits: Column) -> Column:
    padded = F.lpad(digits, WIDE_DIGITS, "0")
    limbs = [F.substring(padded, 1 + LIMB_DIGITS * i, LIMB_DIGITS) for i in range(3)]
    return F.struct(
        limbs[0].cast(L.WEI).alias("high"),
        limbs[1].cast("decimal(28,0)").alias("middle"),
        limbs[2].cast("decimal(28,0)").alias("low"),
    )


def _from_hexadecimal(digits: Column) -> Column:
    """Groups of 32 bits times their weight, added limb by limb: at most 36 digits before the carry."""
    padded = F.lpad(digits, 64, "0")
    totals: list[Column | None] = [None, None, None]
    for shift in range(0, 256, 4 * HEX_GROUP):
        text = F.substring(padded, 65 - HEX_GROUP - shift // 4, HEX_GROUP)
        group = F.conv(text, 16, 10).cast("decimal(10,0)")
        for i, weight in enumerate(_limbs_of(2**shift)):
            if weight:
                part = (group * _decimal(weight)).cast(L.WEI)
                totals[i] = part if totals[i] is None else (totals[i] + part).cast(L.WEI)
    return _carried(*totals)


def parse_wide(text: Column) -> Column:
    """Whole number from decimal or 0x-prefixed hexadecimal text.

    Missing or empty text is 0 as in `parse_amount`; broken text, fractions, exponents, signs other than + and numbers
    of more than 256 bits are NULL. Leading zeros do not count.
    """
    clean = F.lower(F.trim(text))
    hexadecimal = F.ltrim(F.substr(clean, F.lit(3)), F.lit("0"))
    decimal = F.ltrim(F.regexp_replace(clean, r"^[+]", ""), F.lit("0"))
    fits = (F.length(decimal) <= WIDE_DIGITS) & (F.lpad(decimal, WIDE_DIGITS, "0") <= F.lit(str(LARGEST).zfill(WIDE_DIGITS)))
    return (
        F.when(L.is_blank(text), _from_digits(F.lit("")))
        .when(clean.rlike("^0x[0-9a-f]+$") & (F.length(hexadecimal) <= 64), _from_hexadecimal(hexadecimal))
        .when(clean.rlike("^[+]?[0-9]+$") & fits, _from_digits(decimal))
    )


def wide_of(amount: Column) -> Column:
    """A decimal(38,0) amount in wide form; NULL for NULL and for negative amounts."""
    return F.when(amount >= 0, _from_digits(amount.cast("string")))


def wide_sum(amount: Column) -> Column:
    """Exact sum of wide amounts, NULL left out; NULL when there is none.

    Limbs are added apart (map tasks combine them) and carried once at the end; exact for 10^12 rows.
    """
    high, middle, low = (F.sum(amount[name].cast("decimal(28,0)")) for name in ("high", "middle", "low"))
    return F.when(F.count(amount) > 0, _carried(high, middle, low))


def wide_add(left: Column, right: Column) -> Column:
    """Sum of two wide amounts, NULL if one is."""
    total = _carried(*[(left[n] + right[n]).cast(L.WEI) for n in ("high", "middle", "low")])
    return F.when(left.isNotNull() & right.isNotNull(), total)


def wide_text(amount: Column) -> Column:
    """Decimal digits without leading zeros."""
    padded = F.concat(
        amount["high"].cast("string"),
        F.lpad(amount["middle"].cast("string"), LIMB_DIGITS, "0"),
        F.lpad(amount["low"].cast("string"), LIMB_DIGITS, "0"),
    )
    bare = F.ltrim(padded, F.lit("0"))
    return F.when(amount.isNotNull(), F.when(bare == "", "0").otherwise(bare))


def wide_units(amount: Column, decimals: Column | int = 18) -> Column:
    """As a fraction of 10^decimals, nearest double."""
    places = F.lit(decimals) if isinstance(decimals, int) else decimals
    return F.concat(wide_text(amount), F.lit("e-"), places.cast("string")).try_cast("double")
