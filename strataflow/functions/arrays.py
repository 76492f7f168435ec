"""Array functions: 1-based, null-safe equality, duplicates kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def some(a: Column, predicate) -> Column:
    """ANY / SOME: true if any element is, else null if any is unknown, else false."""
    return F.exists(a, predicate)


def every(a: Column, predicate) -> Column:
    """ALL."""
    return F.forall(a, predicate)


def concat(a: Column, b: Column) -> Column:
    """array_cat: null only if both are."""
    both = F.concat(F.coalesce(a, F.slice(b, 1, 0)), F.coalesce(b, F.slice(a, 1, 0)))
    return F.when(a.isNotNull() | b.isNotNull(), both)


def unique(a: Column, b: Column | None = None) -> Column:
    """Distinct elements in the order of their first place; nulls count as one value."""
    return F.array_distinct(a if b is None else concat(a, b))


def difference(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, duplicates kept."""
    return F.filter(a, lambda x: ~F.exists(F.coalesce(b, F.slice(a, 1, 0)), lambda y: x.eqNullSafe(y)))


def overlap(a: Column, b: Column) -> Column:
    """&&: whether they share an element; two nulls are equal; null if an array is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.exists(a, lambda x: F.exists(b, lambda y: x.eqNullSafe(y))))


def position(a: Column, x: object, start: int = 1) -> Column:
    """The first place of x from start on; null if absent. A null x finds a null."""
    value = x if isinstance(x, Column) else F.lit(x)
    places = F.transform(a, lambda y, i: F.when(y.eqNullSafe(value) & (i + 1 >= start), i + 1))
    return F.get(F.filter(places, lambda p: p.isNotNull()), F.lit(0))


def slice_(a: Column, first: int | None = None, last: int | None = None) -> Column:
    """a[first:last], both ends taken; null or empty arrays give no elements; bounds under 1 raise."""
    if (first is not None and first < 1) or (last is not None and last < 1):
        raise ValueError("array bounds start at 1")
    got = F.filter(a, lambda x, i: (i + 1 >= (first or 1)) & (F.lit(last is None) | (i + 1 <= (last or 0))))
    return F.coalesce(got, F.slice(a, 1, 0))


def set_(a: Column, at: int, value: object) -> Column:
    """a with the element at a place from 1 replaced; the array grows by nulls as needed."""
    value = value if isinstance(value, Column) else F.lit(value)
    grown = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(at)))
    return F.transform(grown, lambda i: F.when(i == at, value).otherwise(F.get(a, i - 1)))


def get(a: Column, at: Column | int) -> Column:
    """a[at], 1-based; null out of range."""
    return F.get(a, (at if isinstance(at, Column) else F.lit(at)) - 1)


def sum_(a: Column, kind: str = "double") -> Column:
    """Null if there is no element but nulls."""
    some_ = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(some_) > 0, F.aggregate(some_, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind)))


def avg(a: Column) -> Column:
    some_ = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(some_) > 0, sum_(a) / F.size(some_))


def length(a: Column, dim: int = 1) -> Column:
    """The size along a dimension (of the longest inner array); null if empty or there is no such dimension."""
    if dim < 1:
        return F.lit(None).cast("int")
    size = lambda x: F.nullif(F.size(x), F.lit(0))
    if dim == 1:
        return F.when(a.isNotNull(), size(a))
    return F.array_max(F.transform(a, lambda x: length(x, dim - 1)))


def upper(a: Column, dim: int = 1) -> Column:
    return length(a, dim)


def lower(a: Column, dim: int = 1) -> Column:
    return F.when(length(a, dim).isNotNull(), F.lit(1))


def flatten(a: Column) -> Column:
    """One level; inner nulls are skipped."""
    return F.flatten(F.filter(a, lambda x: x.isNotNull()))


def avg_numeric(a: Column, digits: int = 12) -> Column:
    """The average of decimals, with so many digits after the point; nulls left out, null if there is nothing else."""
    known = F.filter(a, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0).cast(f"decimal(38,{digits})"), lambda s, x: (s + x).cast(f"decimal(38,{digits})"))
    return F.when(F.size(known) > 0, (total / F.nullif(F.size(known), F.lit(0)).cast("decimal(10,0)")).cast(f"decimal(38,{digits})"))


def count(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a).cast("long"))


def null_or_empty(a: Column) -> Column:
    return a.isNull() | (F.size(a) == 0)
