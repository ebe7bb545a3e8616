"""Integer codes: space-filling curves, byte planes, zig-zag, packing, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masks that spread ten bits to every third place.
SPREAD_3D = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))
# The masks that spread sixteen bits to every second place.
SPREAD_2D = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))
KEY_FLAG, SIZE_MASK = 0x80000000, 0x7FFFFFFF


def _spread(x: Column, steps) -> Column:
    x = x.cast("bigint")
    for shift, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Thirty bits from three integers of ten."""
    return F.shiftleft(_spread(z, SPREAD_3D), 2) + F.shiftleft(_spread(y, SPREAD_3D), 1) + _spread(x, SPREAD_3D)


def morton2(x: Column, y: Column) -> Column:
    """Thirty-two bits from two integers of sixteen."""
    return F.shiftleft(_spread(y, SPREAD_2D), 1) + _spread(x, SPREAD_2D)


def ten_bits(x: Column, low: Column, high: Column) -> Column:
    """Truncated to 0 .. 1023; a range without extent gives zero."""
    share = F.when(high > low, F.try_divide(x - low, high - low)).otherwise(0.0)
    return F.least(F.greatest(F.floor(share * 1023), F.lit(0)), F.lit(1023)).cast("bigint")


def composite(position: Column, second: Column) -> Column:
    return F.shiftleft(position, 12).bitwiseOR(second)


def zigzag(x: Column) -> Column:
    return F.when(x < 0, -2 * x - 1).otherwise(2 * x)


def unzigzag(x: Column) -> Column:
    return F.when(x % 2 == 0, F.floor(x / 2)).otherwise(-F.floor((x + 1) / 2))


def delta_byte(x: Column, before: Column) -> Column:
    return F.pmod(x - before, F.lit(256))


def rice_bits(x: Column, k: int) -> Column:
    """Length of a Golomb-Rice code."""
    return F.shiftright(x, k) + 1 + k


def pack_base(x: Column, y: Column, z: Column, base: int) -> Column:
    if base**3 > 256:
        raise ValueError("three digits of the base must fit a byte")
    return x * base * base + y * base + z


def unpack_base(v: Column, base: int) -> list[Column]:
    return [F.floor(v / (base * base)).cast("bigint"), F.floor(v / base).cast("bigint") % base, v % base]


def is_key_frame(size: Column) -> Column:
    return size.bitwiseAND(F.lit(KEY_FLAG).cast("bigint")) != 0


def payload_size(size: Column) -> Column:
    return size.bitwiseAND(F.lit(SIZE_MASK).cast("bigint"))


def natural_key(name: Column) -> Column:
    """Sorts digits as numbers and letters without case: digit runs padded, the rest in lower case.

    Built from the alternating parts of the name; numbers of up to 20 digits sort right.
    """
    texts = F.split(F.lower(name), "[0-9]+", -1)
    numbers = F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    padded = F.transform(numbers, lambda n: F.lpad(F.regexp_replace(n, "^0+(?=.)", ""), 20, "0"))
    return F.array_join(F.zip_with(texts, padded, lambda t, n: F.concat(t, F.coalesce(n, F.lit("")))), "")


def last_integer(name: Column) -> Column:
    """The last run of digits in the stem of a path; null where there is none."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), "\\.[^.]*$", "")
    found = F.regexp_extract_all(stem, F.lit("([0-9]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("bigint"))
