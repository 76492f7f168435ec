"""The stemmer of Porter (1980) as column expressions, with the two later changes of its author (bli, logi)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V, C = "[aeiouy]", "[^aeiouy]"  # a y that is a consonant is written Y in between
#: Conditions on a stem: its measure (how often vowels are followed by consonants), a vowel, a short end.
SOME, TWO, ONE, VOWEL, SHORT = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*\\z", V, f"{C}{V}[^aeiouywxY]\\z"

#: Endings and what takes their place, by step.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
FURTHER = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def without(x: Column, ends, then) -> Column:
    """then(stem, ending) by the longest of the endings that x has; x if it has none."""
    cut = rf"(?s)^(.*?)({'|'.join(ends)})\z"
    parts = F.struct(F.regexp_extract(x, cut, 1).alias("stem"), F.regexp_extract(x, cut, 2).alias("end"))
    return let(parts, lambda p: F.when(p["end"] != "", then(p["stem"], p["end"])).otherwise(x))


def replaced(x: Column, table: dict[str, str], condition: str = "") -> Column:
    by = F.create_map(*[F.lit(s) for kv in table.items() for s in kv])
    return without(x, table, lambda stem, end: F.when(stem.rlike(condition), F.concat(stem, by[end])).otherwise(x))


def mended(x: Column) -> Column:
    """What is left after ed or ing: an e comes back, a doubled consonant becomes one."""
    doubled = r"(?:([^aeiouylsz])\1|yY)\z"
    short = x.rlike(ONE) & x.rlike(SHORT)
    return F.when(x.rlike(r"(?:at|bl|iz)\z") | (~x.rlike(doubled) & short), F.concat(x, F.lit("e"))).when(x.rlike(doubled), F.regexp_replace(x, r"(?s).\z", "")).otherwise(x)


def past(x: Column) -> Column:
    def then(stem: Column, end: Column) -> Column:
        longer = F.when(stem.rlike(SOME), F.concat(stem, F.lit("ee"))).otherwise(x)
        return F.when(end == "eed", longer).when(stem.rlike(VOWEL), mended(stem)).otherwise(x)

    return without(x, ["eed", "ed", "ing"], then)


def final(x: Column) -> Column:
    """Endings that go whole where the measure is over one; ion after s or t only."""
    return without(x, LAST, lambda stem, end: F.when(stem.rlike(TWO) & ((end != "ion") | stem.rlike(r"[st]\z")), stem).otherwise(x))


def tidied(x: Column) -> Column:
    def then(stem: Column, _: Column) -> Column:
        return F.when(stem.rlike(TWO) | (stem.rlike(ONE) & ~stem.rlike(SHORT)), stem).otherwise(x)

    return let(without(x, ["e"], then), lambda y: F.when(y.rlike(r"ll\z") & y.rlike(TWO), F.regexp_replace(y, r"l\z", "")).otherwise(y))


def porter_stem(word: Column) -> Column:
    """The stem of a token in lower case; tokens of one or two letters, or with capitals, stay. Null gives null."""
    out = F.regexp_replace(word, "(^|[aeiouy])y", "$1Y")
    for step in (
        lambda x: replaced(x, PLURALS),
        past,
        lambda x: F.when(x.rlike(rf"{V}.*[yY]\z"), F.regexp_replace(x, r"[yY]\z", "i")).otherwise(x),
        lambda x: replaced(x, DOUBLE, SOME),
        lambda x: replaced(x, FURTHER, SOME),
        final,
        tidied,
    ):
        out = let(out, step)
    return F.when((F.char_length(word) > 2) & ~word.rlike("[A-Z]"), F.translate(out, "Y", "y")).otherwise(word)


def porter():
    """The token filter."""
    return lambda tokens: F.transform(tokens, porter_stem)
