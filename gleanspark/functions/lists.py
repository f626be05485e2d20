"""Sorted lists as arrays: the primitives of posting lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_sorted(items: Column, q: Column) -> Column:
    """0-based place of q in a sorted array; -2 where a greater item comes first, -1 where the array ends before."""
    at = F.filter(F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] >= q)
    return F.when(F.size(at) == 0, F.lit(-1)).when(at[0]["x"] == q, at[0]["i"]).otherwise(F.lit(-2)).cast("int")


def has(items: Column, q: Column) -> Column:
    """struct(match, stop): (q, q) for a hit, (null, first greater item) otherwise."""
    return F.struct(F.when(F.array_contains(items, q), q).alias("match"), F.try_element_at(F.filter(items, lambda x: x >= q), F.lit(1)).alias("stop"))


def is_empty(items: Column) -> Column:
    return F.size(items) == 0


def prepend(items: Column, x: Column) -> Column:
    return F.array_prepend(items, x)


def append(items: Column, x: Column) -> Column:
    return F.array_append(items, x)


def insert_before(items: Column, place: Column, x: Column) -> Column:
    """x in front of the item at a 0-based place."""
    return F.array_insert(items, place + 1, x)


def insert_after(items: Column, place: Column, x: Column) -> Column:
    return F.array_insert(items, place + 2, x)


def insert_ordered(items: Column, x: Column, unique: bool = False) -> Column:
    both = F.array_append(items, x)
    return F.array_sort(F.array_distinct(both) if unique else both)


def from_buffer(items: Column) -> Column:
    """A sorted list without repeats."""
    return F.array_sort(F.array_distinct(items))


def extend(items: Column, more: Column) -> Column:
    return F.concat(items, more)


def splice(items: Column, place: Column, more: Column) -> Column:
    """more behind the item at a 0-based place."""
    return F.concat(F.slice(items, F.lit(1), place + 1), more, F.slice(items, place + 2, F.size(items)))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(*lists: Column) -> Column:
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return F.array_sort(F.array_distinct(out))


def get_slice(items: Column, end: int = 5, start: int = 0) -> Column:
    """Items from a 0-based start up to an end; a negative end means all."""
    if end < 0:
        return F.slice(items, F.lit(start + 1), F.size(items))
    return F.slice(items, start + 1, max(0, end - start))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def count(items: Column) -> Column:
    return F.size(items)


def pretty(items: Column, backwards: bool = False) -> Column:
    text = F.transform(F.reverse(items) if backwards else items, lambda x: x.cast("string"))
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.concat(F.lit("["), F.array_join(text, "]<-[" if backwards else "]->["), F.lit("]")))
