"""Column expressions over values; all stay inside whole-stage code generation unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest float32 step at 1, the default tolerance of float comparison.
FLOAT_EPSILON = 1.1920929e-7


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """use(value) with value computed once; a plain column would be computed again for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signed_code(value: str | Column) -> Column:
    """Unsigned code of a signed number: 2 v for v >= 0, 2 (-v - 1) + 1 below."""
    v = col(value).cast("long")
    return F.when(v >= 0, F.shiftleft(v, 1)).otherwise(F.shiftleft(-(v + 1), 1).bitwiseOR(F.lit(1).cast("long")))


def signed_value(code: str | Column) -> Column:
    """Inverse of signed_code."""
    c = col(code).cast("long")
    half = F.shiftrightunsigned(c, 1)
    return F.when(c.bitwiseAND(F.lit(1).cast("long")) == 0, half).otherwise(-half - 1)


def low_bits(value: str | Column, n: int) -> Column:
    """The first n raw bits of an element's code."""
    return signed_code(value).bitwiseAND(F.lit((1 << n) - 1))


def bit_of(value: str | Column, i: int) -> Column:
    """Bit i of an element's code."""
    return F.shiftright(signed_code(value), i).bitwiseAND(F.lit(1).cast("long"))


def float_parts(value: str | Column) -> Column:
    """Raw sign, exponent and mantissa of a float32 as a struct, from the number itself; NULL for NULL.

    Zero has both at 0, infinities have exponent 255 and mantissa 0, NaN is the one of mantissa 2^22.
    """
    v = col(value).cast("float").cast("double")
    fine = F.abs(v) < float("inf")
    a = F.when(fine, F.abs(v)).otherwise(1.0)
    e = F.floor(F.log2(a))
    e = e + (a >= F.pow(F.lit(2.0), e + 1)).cast("long") - (a < F.pow(F.lit(2.0), e)).cast("long")
    normal = e >= -126
    exponent = F.when(~fine, 255).when(a == 0, 0).when(normal, e + 127).otherwise(0).cast("long")
    scaled = F.when(normal, a / F.pow(F.lit(2.0), e) - 1).otherwise(a / F.pow(F.lit(2.0), F.lit(-126)))
    mantissa = F.when(F.isnan(v), 1 << 22).when(~fine | (a == 0), 0).otherwise(F.round(scaled * (1 << 23))).cast("long")
    sign = F.startswith(v.cast("string"), F.lit("-")).cast("long")  # negative zero compares as zero
    return F.when(v.isNotNull(), F.struct(sign.alias("sign"), exponent.alias("exponent"), mantissa.alias("mantissa")))


def float_of(parts: str | Column) -> Column:
    """The float32 of a struct as float_parts makes it."""
    p = col(parts)
    exponent, fraction = p["exponent"], p["mantissa"] / float(1 << 23)
    scaled = F.when(exponent == 0, fraction * 2.0**-126).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    special = F.when(p["mantissa"] == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    size = F.when(exponent == 255, special).otherwise(scaled)
    return F.when(p["sign"] == 1, -size).otherwise(size).cast("float")


def clip_high(value: str | Column, h: int) -> Column:
    """Non-negative values of more than h + 1 bits become h + 1 ones."""
    v = col(value).cast("long")
    return F.when(F.shiftrightunsigned(v, h + 1) != 0, F.lit((1 << (h + 1)) - 1).cast("long")).otherwise(v)


def clip_low(value: str | Column, b: int) -> Column:
    """Bits below b go; bit b is set as well if exactly one of the bits above and the bits below holds any."""
    v = col(value).cast("long")
    high = F.shiftrightunsigned(v, b + 1) != 0
    low = v.bitwiseAND(F.lit((1 << b) - 1).cast("long")) != 0
    kept = F.shiftleft(F.shiftrightunsigned(v, b), b)
    return F.when(high != low, kept.bitwiseOR(F.lit(1 << b).cast("long"))).otherwise(kept)


def three_way(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1; NULL reads as 0 or as the empty text."""
    return F.when(col(a) < col(b), -1).when(col(a) > col(b), 1).otherwise(0)


def compare_int(value: str | Column, x: int) -> Column:
    return three_way(F.coalesce(col(value), F.lit(0)), F.lit(x))


def compare_float(value: str | Column, x: float, epsilon: float = FLOAT_EPSILON) -> Column:
    """Equal within epsilon."""
    v = F.coalesce(col(value), F.lit(0.0))
    return F.when(F.abs(v - F.lit(x)) <= epsilon, 0).when(v < x, -1).otherwise(1)


def compare_text(value: str | Column, x: str) -> Column:
    return three_way(F.coalesce(col(value), F.lit("")), F.lit(x))


def octet(value: str | Column, k: int) -> Column:
    """Byte k of a text's UTF-8 form, 0 past its end."""
    part = F.substring(F.encode(col(value), "UTF-8"), k + 1, 1)
    return F.coalesce(F.conv(F.nullif(F.hex(part), F.lit("")), 16, 10).cast("int"), F.lit(0))


def number_octet(value: str | Column, k: int) -> Column:
    """Byte k of a number's code."""
    return F.shiftrightunsigned(signed_code(value), 8 * k).bitwiseAND(F.lit(255).cast("long"))


def set_octet(value: str | Column, k: int, char: str) -> Column:
    """Text with byte k of its UTF-8 form replaced; shorter texts stay as they are."""
    v = F.encode(col(value), "UTF-8")
    return F.when(F.octet_length(v) > k, F.overlay(v, F.encode(F.lit(char), "UTF-8"), F.lit(k + 1), F.lit(1)).cast("string")).otherwise(col(value))


def insert_octet(value: str | Column, k: int, char: str) -> Column:
    """Text with a character put in before byte k of its UTF-8 form."""
    v = F.encode(col(value), "UTF-8")
    return F.when(F.octet_length(v) >= k, F.overlay(v, F.encode(F.lit(char), "UTF-8"), F.lit(k + 1), F.lit(0)).cast("string")).otherwise(col(value))


def common_prefix(a: str | Column, b: str | Column) -> Column:
    """Length of the longest common prefix in octets, by the octets' hexadecimal forms, each cut once."""

    def octets(v: str | Column) -> Column:
        return F.regexp_extract_all(F.hex(F.encode(F.coalesce(col(v), F.lit("")), "UTF-8")), F.lit("(..)"), F.lit(1))

    def length(same: Column) -> Column:
        n = F.array_position(same, F.lit(False)).cast("int")
        return F.when(n > 0, n - 1).otherwise(F.size(same))

    return bound(F.zip_with(octets(a), octets(b), lambda x, y: F.coalesce(x == y, F.lit(False))), length)


def kleene(value: str | Column) -> Column:
    """1 for true, -1 for false, 0 for unknown."""
    v = col(value)
    return F.when(v, 1).when(~v, -1).otherwise(0)


def init_kleene(value: str | Column, known: str | Column) -> Column:
    """A three-valued element from a value bit and a known bit: unknown unless known."""
    return F.when(col(known), col(value))


def set_kleene(current: str | Column, where: Column, code: int) -> Column:
    """Element with -1, 0 or 1 assigned where the condition holds."""
    return F.when(where, from_kleene(F.lit(code))).otherwise(col(current))


def compare_octet(value: str | Column, k: int, x: int) -> Column:
    """Byte k of a text against a number: -1, 0 or 1."""
    return three_way(octet(value, k), F.lit(x))


def from_kleene(code: str | Column) -> Column:
    c = col(code)
    return F.when(c > 0, F.lit(True)).when(c < 0, F.lit(False))


def kleene_not(a) -> Column:
    return ~col(a)


def kleene_and(*values) -> Column:
    out = col(values[0])
    for v in values[1:]:
        out = out & col(v)
    return out


def kleene_or(*values) -> Column:
    out = col(values[0])
    for v in values[1:]:
        out = out | col(v)
    return out


def code_and(a, b) -> Column:
    """AND of codes -1, 0, 1."""
    return F.least(col(a), col(b))


def code_or(a, b) -> Column:
    return F.greatest(col(a), col(b))
