"""Arithmetic with integer division, checked domains and rounding as a PostgreSQL-like engine has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(ok: Column, value: Column, message: str) -> Column:
    """value where ok holds or is null, else an error."""
    return F.when(ok | ok.isNull(), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def divide(a: Column, b: Column) -> Column:
    """Integers divide to an integer, rounded towards zero; a zero divisor raises."""
    return F.call_function("div", a, b)


def modulus(a: Column, b: Column) -> Column:
    """The remainder has the sign of the dividend."""
    return a % b


def round_(x: Column, digits: int | None = None) -> Column:
    """One argument: to a bigint, halves up (-2.5 to -2). Two: halves away from zero."""
    return F.floor(x + 0.5).cast("long") if digits is None else F.round(x, digits)


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero."""
    scale = float(10**digits)
    cut = F.signum(x) * F.floor(F.abs(x) * scale) / scale
    return cut if digits else cut.cast("long")


def sqrt(x: Column) -> Column:
    return checked(x >= 0, F.sqrt(x), "square root of a negative number")


def ln(x: Column) -> Column:
    return checked(x > 0, F.ln(x), "logarithm of a number that is not positive")


def log(x: Column, base: float = 10.0) -> Column:
    """log(value, base); the base is 10 if left out."""
    return checked(x > 0, F.log10(x) if base == 10.0 else F.ln(x) / F.ln(F.lit(float(base))), "logarithm of a number that is not positive")


def asin(x: Column) -> Column:
    return checked(F.abs(x) <= 1, F.asin(x), "asin is defined from -1 to 1")


def acos(x: Column) -> Column:
    return checked(F.abs(x) <= 1, F.acos(x), "acos is defined from -1 to 1")


def cot(x: Column) -> Column:
    return 1 / F.tan(x)


def bits(op: str, a: Column, b: Column) -> Column:
    """and, or, xor of integers, or of bit strings of equal length."""
    return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[op](b)


def bit_strings(op: str, a: Column, b: Column) -> Column:
    one = {"and": lambda x, y: (x == "1") & (y == "1"), "or": lambda x, y: (x == "1") | (y == "1"), "xor": lambda x, y: x != y}[op]
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    joined = F.array_join(F.zip_with(chars(a), chars(b), lambda x, y: F.when(one(x, y), "1").otherwise("0")), "")
    return F.when(F.char_length(a) == F.char_length(b), joined).otherwise(F.raise_error(F.lit("bit strings differ in length")).cast("string"))
