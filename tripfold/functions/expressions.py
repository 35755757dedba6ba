"""Column expressions: times, speeds, rounding and path hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tripfold.schema import DATE, ISO_TIME, PLAIN_TIME

_LOW_32 = 4_294_967_295
_SIGN_BIT = 2_147_483_648


def parse_time(text: Column) -> Column:
    """Either text form as a timestamp; NULL where neither fits."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(PLAIN_TIME)), F.try_to_timestamp(text, F.lit(ISO_TIME))
    )


def parse_date(text: Column) -> Column:
    return F.try_to_date(text, DATE)


def plain_time(ts: Column) -> Column:
    return F.date_format(ts, PLAIN_TIME)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, ISO_TIME)


def plain_date(day: Column) -> Column:
    return F.date_format(day, DATE)


def day_of_week(day: Column) -> Column:
    """Lower-case English day name."""
    return F.lower(F.date_format(day, "EEEE"))


def round3(value: Column) -> Column:
    """Three decimals, halves to the even digit."""
    return F.bround(value, 3)


def exact_sum(rounded: Column) -> Column:
    """Aggregate: sum of values of few decimals, the same in any order of adding.

    Summed as whole millionths, so that a retried or split task cannot change the last digit; as
    decimals, which hold any number of the largest distances.
    """
    return F.sum(F.rint(rounded * 1_000_000).cast("decimal(28,0)")).cast("double") / 1_000_000


def any_order_sum(value: Column) -> Column:
    """Aggregate: sum of doubles as decimals of 18 places, the same in any order of adding."""
    return F.sum(value.cast("decimal(38,18)")).cast("double")


def speed(distance: Column, seconds: Column) -> Column:
    """Distance per hour; NULL for zero seconds."""
    return F.try_divide(distance * 3600, seconds)


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24 hour periods, truncated towards zero."""
    return F.timestamp_diff("DAY", start, end)


def calendar_days(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")


def to_int32(bits: Column) -> Column:
    """Low 32 bits of a bigint as a signed int."""
    low = (bits + _SIGN_BIT).bitwiseAND(F.lit(_LOW_32))
    return (low - _SIGN_BIT).cast("int")


def text_hash(text: Column) -> Column:
    """The 32-bit string hash of the JVM: base 31 over the UTF-16 code units; NULL for NULL.

    Folded with a lambda, which is slower than calling the JVM through `reflect`; but Spark takes
    that for non-deterministic, and moves no filter below it.
    """
    ascii_units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    four_digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"))
    units = F.transform(four_digits, lambda x: F.conv(x, 16, 10).cast("bigint"))
    plain = F.octet_length(text) == F.char_length(text)
    total = F.aggregate(
        F.when(plain, ascii_units).otherwise(units),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + c).bitwiseAND(F.lit(_LOW_32)),
    )
    return to_int32(total).cast("bigint")


def path_hash(path: Column, path_rev: Column) -> Column:
    """Hash of a path that is the same when path and path_rev change places."""
    return mixed_hash(text_hash(F.greatest(path, path_rev)), text_hash(F.least(path, path_rev)))


def mixed_hash(greater: Column, lesser: Column) -> Column:
    """The path hash from the hashes of the greater and the lesser text."""
    return to_int32(greater + lesser * 31)


def utf16_length(text: str) -> str:
    """SQL: the length of a text in UTF-16 code units."""
    wide = f"octet_length(encode({text}, 'UTF-16BE')) div 2"
    return f"IF(octet_length({text}) = char_length({text}), CAST(char_length({text}) AS bigint), {wide})"


def low32(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(_LOW_32))


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, without a product beyond 48 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(65_535)), 16)
    return low32(a * b.bitwiseAND(F.lit(65_535)) + high)


# 31 to the power of 2**27 is 1 modulo 2**32, so 27 bits of an exponent count: three digits of nine.
_DIGIT = 9


def _digit_powers(digit: int) -> np.ndarray:
    base = pow(31, 1 << (_DIGIT * digit), 1 << 32)
    return np.array([pow(base, k, 1 << 32) for k in range(1 << _DIGIT)], np.int64)


_POWERS = [_digit_powers(d) for d in range(3)]
INVERSE_31 = pow(31, -1, 1 << 32)


def power31(exponent: Column) -> Column:
    """31 to a power modulo 2**32; a negative exponent gives the inverse."""
    powers = []
    for digit, table in enumerate(_POWERS):
        place = F.shiftright(exponent, _DIGIT * digit).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        # An array as one literal: 512 literals would be as many nodes of a plan.
        powers.append(F.get(F.lit(table), place.cast("int")))
    return times32(times32(powers[0], powers[1]), powers[2])
