"""Keys of two unsigned 64-bit words, and arithmetic modulo 2**64.

Columns hold a word as a signed long with the same 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 64
#: Fixed values of the generators.
HASH_FACTOR = 11400714819323198393
VALUE_FACTOR = 1469598103934665603
VALUE_LO = 0x9E3779B97F4A7C15
VALUE_HI = 0x517CC1B727220A95


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _number(n: int) -> Column:
    """A Python integer beyond the range of long."""
    return F.lit(str(n)).cast("decimal(38,0)")


def constant(value: int) -> Column:
    """A word given as a Python integer."""
    value %= WORD
    return F.lit(value - WORD if value >> 63 else value)


def unsigned(x: Column) -> Column:
    """The word's unsigned value as decimal(20, 0)."""
    return F.when(x < 0, _wide(x) + _number(WORD)).otherwise(_wide(x)).cast("decimal(20,0)")


def word(x: Column) -> Column:
    """The word of a decimal value, taken modulo 2**64."""
    whole = _number(WORD)
    rest = F.pmod(_wide(x), whole)
    return F.when(rest >= _number(1 << 63), rest - whole).otherwise(rest).cast("long")


def plus(x: Column, value: int) -> Column:
    """x + value modulo 2**64."""
    return word(_wide(x) + _number(value % WORD))


def times(x: Column, value: int) -> Column:
    """x * value modulo 2**64, by 32-bit halves, so that no product leaves a decimal."""
    value %= WORD
    half, low = 1 << 32, (1 << 32) - 1
    xl, xh = _wide(x.bitwiseAND(F.lit(low))), _wide(F.shiftrightunsigned(x, 32))
    dec = lambda n: _number(n).cast("decimal(20,0)")
    middle = F.pmod((xh.cast("decimal(10,0)") * dec(value & low) + xl.cast("decimal(10,0)") * dec(value >> 32)).cast("decimal(38,0)"), _number(half))
    return word((xl.cast("decimal(10,0)") * dec(value & low)).cast("decimal(38,0)") + (middle.cast("decimal(10,0)") * dec(half)).cast("decimal(38,0)"))


def sort_key(prefix: Column, suffix: Column) -> Column:
    """16 bytes whose order is the unsigned order of (prefix, suffix)."""
    part = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(part(prefix), part(suffix))


def flipped(x: Column) -> Column:
    """A long whose signed order is the word's unsigned order."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def hash_key(i: Column) -> Column:
    return times(i + 1, HASH_FACTOR)


def value_lo(prefix: Column, suffix: Column) -> Column:
    return times(prefix, VALUE_FACTOR).bitwiseXOR(plus(suffix, VALUE_LO))


def value_hi(prefix: Column, suffix: Column) -> Column:
    return F.shiftleft(suffix, 1).bitwiseXOR(plus(prefix, VALUE_HI))


def at_or_after(prefix: int, suffix: int) -> Column:
    """key >= (prefix, suffix).  The first condition is implied; scans can push it down."""
    p, s = F.col("prefix"), F.col("suffix")
    return (p >= prefix) & ((p > prefix) | (s >= suffix))


def at_or_before(prefix: int, suffix: int) -> Column:
    p, s = F.col("prefix"), F.col("suffix")
    return (p <= prefix) & ((p < prefix) | (s <= suffix))
