"""Column expressions for addresses, amounts, hashes and time; all of them stay inside the JVM."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEI = "decimal(38,0)"
WEI_PER_ETH = 1e18
WEI_PER_GWEI = 1e9


def clean_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def normalize_address(c: Column) -> Column:
    """Lower-case, trimmed; '' when missing."""
    return clean_text(F.coalesce(c, F.lit("")))


def address_or_null(c: Column) -> Column:
    """Lower-case, trimmed; NULL when missing or blank."""
    return F.nullif(clean_text(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def wei_to_ether(c: Column) -> Column:
    return c.cast("double") / F.lit(WEI_PER_ETH)


def wei_sum(c: Column) -> Column:
    """Sum of wei amounts in whole numbers, so the result does not depend on the order of rows."""
    return F.sum(c).cast(WEI)


def ether_sum(c: Column) -> Column:
    return wei_to_ether(F.sum(c))


def ether_avg(c: Column) -> Column:
    return F.try_divide(ether_sum(c), F.count(c))


def zero_wei() -> Column:
    return F.lit(0).cast(WEI)


def pack_text(c: Column) -> Column:
    """Text as bytes for a shuffle: hashes and addresses (0x and pairs of lower-case digits) take half, any other text a
    byte more. `unpack_text` gives the same text back."""
    digits = F.unhex(F.substr(c, F.lit(3)))
    packed = F.concat(F.unhex(F.lit("01")), digits)
    return F.when(unpack_text(packed) == c, packed).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpack_text(c: Column) -> Column:
    rest = F.substr(c, F.lit(2))
    plain = F.decode(rest, "UTF-8")
    return F.when(F.substr(c, F.lit(1), F.lit(1)) == F.unhex(F.lit("01")), F.concat(F.lit("0x"), F.lower(F.hex(rest)))).otherwise(plain)


def record_hash(*fields: Column) -> Column:
    """SHA-256 over '|'-joined fields; a missing field counts as the text None."""
    texts = [F.coalesce(f.cast("string"), F.lit("None")) for f in fields]
    return F.sha2(F.concat_ws("|", *texts), 256)


def unix_to_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("bigint"))


def parse_amount(c: Column) -> Column:
    """Whole number from decimal or 0x-prefixed hexadecimal text of up to 256 bits.

    Missing or empty text is 0; amounts over 38 digits and broken text (`0x` without digits too) are NULL. Leading zeros
    of any number do not count. Hexadecimal is read in three groups of 12 digits because a single `conv` holds only 64
    bits.
    """
    text = F.lower(F.trim(c))
    digits = F.ltrim(F.substr(text, F.lit(3)), F.lit("0"))
    padded = F.lpad(digits, 36, "0")
    groups = [F.conv(F.substring(padded, start, 12), 16, 10).cast(WEI) for start in (1, 13, 25)]
    weights = [F.lit(str(2**shift)).cast(WEI) for shift in (96, 48, 0)]
    parts = [F.try_multiply(g, w).cast(WEI) for g, w in zip(groups, weights)]
    total = F.try_add(F.try_add(parts[0], parts[1]), parts[2])
    hexadecimal = F.when(text.rlike("^0x[0-9a-f]+$") & (F.length(digits) <= 32), total)
    return (
        F.when(is_blank(c), zero_wei())
        .when(text.startswith("0x"), hexadecimal)
        .otherwise(text.try_cast(WEI))
        .cast(WEI)
    )


def amount_overflows(text: Column) -> Column:
    """True for a number that `parse_amount` cannot hold in 38 digits; false for missing and broken text."""
    number = F.lower(F.trim(text)).rlike(r"^(0x[0-9a-f]+|[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)$")
    return F.coalesce(number & parse_amount(text).isNull(), F.lit(False))


def optional_count(c: Column) -> Column:
    """Whole number from text; NULL for missing or empty text."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("bigint")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def point_in_time(as_of: Column | DataFrame | dt.datetime | str | None, df: DataFrame, time_column: str) -> Column:
    """The moment "now" refers to: a given value, a one-cell frame, or the latest time in `df`."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, DataFrame):
        return as_of.scalar()
    if as_of is None:
        return df.agg(F.max(time_column)).scalar()
    return F.lit(as_of).cast("timestamp")


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL '{int(days)}' DAY")
