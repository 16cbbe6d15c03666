"""Functions on arrays, maps and JSON objects that Spark has under no single name (§2.16)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import json_type


def _keyed(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Structs (k, i, x) of an array's elements with their key and place."""
    return F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))


def sort_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """The elements by a key; equal keys keep their order."""
    return F.transform(F.array_sort(_keyed(arr, key)), lambda s: s["x"])


def min_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of smallest key; NULL for an empty array."""
    return F.array_min(_keyed(arr, key))["x"]


def max_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of greatest key; NULL for an empty array."""
    return F.array_max(F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))))["x"]


def not_null(*columns: Column) -> Column:
    return F.coalesce(*columns)


def merge(*maps: Column) -> Column:
    """One map of several; the last that has a key wins."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def with_entries(m: Column, f: Callable[[Column], Column]) -> Column:
    """A map of the entries (key, value) that `f` makes of a map's entries; of equal keys the last stays."""
    made = F.transform(F.map_entries(m), f)
    last = F.filter(made, lambda e, i: ~F.array_contains(F.transform(F.slice(made, i + 2, F.size(made)), lambda o: o["key"]), e["key"]))
    return F.map_from_entries(last)


def select_type(arr: Column, *kinds: str) -> Column:
    """The variants of an array that are of the kinds: strings, numbers, objects and so on by `json_type`."""
    return F.filter(arr, lambda x: json_type(x).isin(*kinds))


def alternative(value: Column, other: Column) -> Column:
    """`other` where a boolean or other value is null or false."""
    return F.when(value.isNull() | (value.cast("string") == "false"), other).otherwise(value)


def nth(arr: Column, n: int) -> Column:
    """The element at place n from 0, from the end if negative; NULL where there is none."""
    return F.try_element_at(arr, F.lit(n + 1 if n >= 0 else n))


def limit(arr: Column, n: int) -> Column:
    return F.slice(arr, 1, max(n, 0))


def until(arr: Column, stop: Callable[[Column], Column]) -> Column:
    """The elements before the first for which `stop` holds."""
    at = F.array_position(F.transform(arr, stop), True)
    return F.when(at > 0, F.slice(arr, F.lit(1), (at - 1).cast("int"))).otherwise(arr)


def transpose(rows: Column) -> Column:
    """Columns of an array of arrays as arrays; short rows give NULL."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))


def combinations(rows: Column, empty: str = "array<array<double>>") -> Column:
    """Every choice of one element of each inner array, in order."""
    start = F.array(F.array()).cast(empty)
    more = lambda acc, r: F.flatten(F.transform(acc, lambda c: F.transform(r, lambda x: F.concat(c, F.array(x)))))
    return F.aggregate(rows, start, more)


def set_member(v: Column, key: str, value: Column) -> Column:
    """A JSON object with a member set to a VARIANT or other value, other kinds unchanged."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    out = merge(members, F.create_map(F.lit(key), value if isinstance(value, Column) else F.lit(value)))
    return F.when(json_type(v) == "object", F.parse_json(F.to_json(out))).otherwise(v)


def update_member(v: Column, key: str, f: Callable[[Column], Column]) -> Column:
    """A JSON object with `f` applied to one of its members (update assignment)."""
    return set_member(v, key, f(F.try_variant_get(v, f"$.{key}", "variant")))


def delete_members(v: Column, *keys: str) -> Column:
    """A JSON object without some members, other kinds unchanged."""
    members = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*keys))
    return F.when(json_type(v) == "object", F.parse_json(F.to_json(members))).otherwise(v)
