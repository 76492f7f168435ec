"""Spans of regular expressions in whole texts with JVM functions only, as the PII and secret operators need them.

A rule's matches come from regexp_extract_all; split by the same expression gives the text between
them, so running lengths give every start without a Python function. The expressions are written
with possessive quantifiers: the matches are those of the plain forms, but Java neither recurses for
each repetition nor scans a run of characters once for each of its starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

BLOCK = 256
SPAN = "struct<start:int,kind:int,stop:int,match:string>"


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a Java expression; hint: a cheap expression that finds something in any text with a
    match ('' for none); keep: a Column of a matched string, true where the match stands."""

    kind: str
    pattern: str
    hint: str = ""
    keep: object = None


def folded(items: Column, none: Column, step) -> Column:
    """struct<at, out> after step(at, x), a pair of the next at (from 0) and an array to add to out, for each x of items;
    none: the empty array of out's type."""

    def add(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))

    def whole(every: Column) -> Column:
        last = F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(every, k * BLOCK + 1, BLOCK))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), block)

    return let(items, whole)


def found(text: Column, rule: Rule, number: int) -> Column:
    """array<SPAN> of the rule's leftmost non-overlapping matches in text, without the dropped ones."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    got = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        stop = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), stop.alias("stop"), x["m"].alias("match"))
        return stop, F.array(one) if rule.keep is None else F.when(rule.keep(x["m"]), F.array(one)).otherwise(none)

    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), got.alias("m")), lambda x: x["m"].isNotNull())
    spans = folded(zipped, none, step)["out"]
    has = F.lit(True) if not rule.hint else text.rlike(rule.hint)
    return F.when(has & text.rlike(rule.pattern), spans).otherwise(none)


def listed(spans: Column, kinds: list[str]) -> Column:
    """'kind:start:stop' of spans by start, then kind in the order listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def digest_columns(spans: Column, kinds: list[str], base: int) -> dict[str, Column]:
    """n_<kind> of the first base kinds, base_sha256 over these, and spans over all kinds, as text."""

    def count(number: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == number)).cast("long")

    out = {f"n_{k}": count(i) for i, k in enumerate(kinds[:base])}
    out["base_sha256"] = F.sha2(listed(F.filter(spans, lambda x: x["kind"] < base), kinds), 256)
    return out | {"spans": listed(spans, kinds)}
