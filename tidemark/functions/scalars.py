"""Scalar helpers, each a composition of JVM built-ins (no Python UDF).

Where the engine's contract differs from SQL defaults, the difference is
stated at the function: integer division and remainder by zero give 0, string
length is in bytes, and decimal parsing truncates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in km (fixed value of the contract).
EARTH_KM = 6371.0


def col(name: str) -> Column:
    return F.col(name)


def lit_i(value: int) -> Column:
    """A 64-bit integer; Python ints would otherwise become 32-bit."""
    return F.lit(value).cast("long")


def lit_s(value: str) -> Column:
    return F.lit(value)


def compare(kind: str, left: Column, right: Column) -> Column:
    """A comparison by name: eq, ne, lt, le, gt, ge."""
    ops = {
        "eq": lambda: left == right,
        "ne": lambda: left != right,
        "lt": lambda: left < right,
        "le": lambda: left <= right,
        "gt": lambda: left > right,
        "ge": lambda: left >= right,
    }
    if kind not in ops:
        raise ValueError(f"unknown comparison: {kind}")
    return ops[kind]()


def and_(left: Column, right: Column) -> Column:
    return left & right


def or_(left: Column, right: Column) -> Column:
    return left | right


def not_(condition: Column) -> Column:
    return ~condition


def like(text: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash stands for itself."""
    return text.like(pattern.replace("\\", "\\\\"))


def len_str(text: Column) -> Column:
    """Length in bytes."""
    return F.octet_length(text).cast("long")


def add(left: Column, right: Column) -> Column:
    return left + right


def sub(left: Column, right: Column) -> Column:
    return left - right


def mul(left: Column, right: Column) -> Column:
    return left * right


def _int_div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def div(left: Column, right: Column) -> Column:
    """Integer quotient truncated toward zero; 0 if the divisor is 0."""
    return F.coalesce(_int_div(left, F.nullif(right, lit_i(0))), lit_i(0))


def mod(left: Column, right: Column) -> Column:
    """Remainder with the sign of the dividend; 0 if the divisor is 0."""
    return F.coalesce(F.try_mod(left, right), lit_i(0))


def in_ints(value: Column, members: Iterable[int]) -> Column:
    return value.isin(*members)


def case_when(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def extract_minute(seconds: Column) -> Column:
    """Minute of the hour of an epoch second; no session zone involved."""
    return _int_div(seconds, lit_i(60)) % lit_i(60)


def date_trunc_minute(seconds: Column) -> Column:
    """Epoch second cut to its minute, toward zero."""
    return seconds - seconds % lit_i(60)


#: Shift and mask of each step that spreads 32 bits over the even bits.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(value: Column) -> Column:
    out = value.bitwiseAND(lit_i(0xFFFFFFFF))
    for shift, mask in SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(lit_i(mask))
    return out


def z_order_2d(a: Column, b: Column) -> Column:
    """Morton code of the low 32 bits: ``a`` on even bits, ``b`` on odd."""
    return _spread(a).bitwiseOR(F.shiftleft(_spread(b), 1))


def json_get(text: Column, key: str, textual: bool = False) -> Column:
    """Value of a top-level key as text, '' if absent.

    ``textual`` takes the first textual occurrence of the quoted key instead,
    nested or not, in valid JSON or not."""
    if not textual:
        if "'" in key or not key:  # no path can name such a key
            return F.coalesce(F.try_element_at(F.from_json(text, "map<string,string>"), F.lit(key)), F.lit(""))
        return F.coalesce(F.get_json_object(text, f"$['{key}']"), F.lit(""))
    pattern = f'(?s)^(?>.*?"{re.escape(key)}")[^:]*+:[ \\t]*+(?:"([^"]*)"|(?!")([^,}} ]*))'
    return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def json_get_int(text: Column, key: str, textual: bool = False) -> Column:
    """Leading integer of a key's value, 0 if there is none."""
    digits = F.regexp_extract(json_get(text, key, textual), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("long"), lit_i(0))


def array_length(text: Column) -> Column:
    """Elements of a bracketed list such as ``[1,2,3]``; 0 for other text."""
    listed = text.startswith("[") & text.endswith("]") & (F.length(text) > 2)
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return F.when(listed, commas + 1).otherwise(0).cast("long")


def array_contains_int(text: Column, value: int) -> Column:
    """1 if the list's text holds the number between its delimiters, else 0."""
    return text.rlike(rf"[\[,]{int(value)}[,\]]").cast("long")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km of two points in degrees."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def parse_decimal(text: Column, scale: int) -> Column:
    """Text to an integer scaled by 10^scale; further digits are cut off."""
    pattern = r"^([+-]?)(\d*)(?:\.(\d*))?"
    whole = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("long"), lit_i(0)) * lit_i(10**scale)
    if scale:
        fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 3), 1, scale), scale, "0")
        whole = whole + fraction.cast("long")
    return F.when(F.regexp_extract(text, pattern, 1) == "-", -whole).otherwise(whole)


def format_decimal(value: Column, scale: int) -> Column:
    """The inverse: sign, whole part and ``scale`` zero-padded digits."""
    sign, size = F.when(value < 0, "-").otherwise(""), F.abs(value)
    if not scale:
        return F.concat(sign, size.cast("string"))
    unit = lit_i(10**scale)
    return F.concat(sign, _int_div(size, unit).cast("string"), F.lit("."), F.lpad((size % unit).cast("string"), scale, "0"))


def decimal_mul(a: Column, b: Column, scale: int) -> Column:
    """Product of two scaled integers at the same scale, truncated."""
    return _int_div(a * b, lit_i(10**scale))
