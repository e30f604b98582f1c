"""Scalar and aggregate helpers: plain functions over ``Column``."""

from .aggregates import avg, count, count_distinct, count_star, max_, min_, sum_
from .scalars import (
    add,
    and_,
    array_contains_int,
    array_length,
    case_when,
    col,
    compare,
    date_trunc_minute,
    decimal_mul,
    div,
    extract_minute,
    format_decimal,
    haversine,
    in_ints,
    json_get,
    json_get_int,
    len_str,
    like,
    lit_i,
    lit_s,
    mod,
    mul,
    not_,
    or_,
    parse_decimal,
    sub,
    z_order_2d,
)

__all__ = [
    "add", "and_", "array_contains_int", "array_length", "avg", "case_when", "col", "compare", "count", "count_distinct",
    "count_star", "date_trunc_minute", "decimal_mul", "div", "extract_minute", "format_decimal", "haversine", "in_ints",
    "json_get", "json_get_int", "len_str", "like", "lit_i", "lit_s", "max_", "min_", "mod", "mul", "not_", "or_",
    "parse_decimal", "sub", "sum_", "z_order_2d",
]
