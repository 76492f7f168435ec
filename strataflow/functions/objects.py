"""Objects: structs where the schema is known, JSON strings or maps where it is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subscript(o: Column, *path: str) -> Column:
    """A field of a struct, by path; an unknown one is an analysis error."""
    for k in path:
        o = o.getField(k)
    return o


def json_subscript(o: Column, *path: str) -> Column:
    """A value of a JSON text by path, as text; null if it is absent (the dynamic policy)."""
    return F.get_json_object(o, "$" + "".join(f"['{k}']" for k in path))


def keys(o: Column, json: bool = False) -> Column:
    return F.json_object_keys(o) if json else F.map_keys(o)


def merge(a: Column, b: Column) -> Column:
    """Maps put together, the right one first; a null side is left out."""
    pairs = lambda m: F.map_entries(m)
    kept = F.filter(pairs(a), lambda e: ~F.array_contains(F.map_keys(b), e["key"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_from_entries(F.concat(kept, pairs(b))))


def null_or_empty(o: Column) -> Column:
    return o.isNull() | (F.size(o) == 0)
