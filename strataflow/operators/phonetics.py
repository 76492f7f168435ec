"""Phonetic token filters and further ones of analyzer chains, as column expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import Step, each


def soundex() -> Step:
    """A letter and three digits."""
    return each(lambda x: F.soundex(F.upper(x)))


def refined_soundex() -> Step:
    """A letter and a digit for each letter, runs of equal digits once."""

    def one(x: Column) -> Column:
        plain = F.regexp_replace(F.upper(x), "[^A-Z]", "")
        # fixed values: the code of each letter of the alphabet
        codes = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01360240043788015936020505")
        return F.concat(F.substr(plain, F.lit(1), F.lit(1)), F.regexp_replace(codes, r"(.)\1+", "$1"))

    return each(one)


#: Spelling rules of the Kölner Phonetik (Postel, 1969), in order of use.
COLOGNE = [
    ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "s"), ("ph", "f"), ("[^a-z]", ""), ("[dt](?=[csz])", "8"), ("[dt]", "2"), ("[fvw]", "3"), ("(?<=[ckq])x", "8"), ("x", "48"), ("(?<=[sz])c", "8"), ("^c(?=[ahkloqrux])", "4"), ("^c", "8"),
    ("c(?=[ahkoqux])", "4"), ("c", "8"), ("[gkq]", "4"), ("[bp]", "1"), ("l", "5"), ("[mn]", "6"), ("r", "7"), ("[sz]", "8"), ("h", ""), ("[aeijouy]", "0"),
]


def cologne() -> Step:
    """The Kölner Phonetik: digits, runs once, zeros only in front."""

    def one(x: Column) -> Column:
        out = F.lower(x)
        for rule, to in COLOGNE:
            out = F.regexp_replace(out, rule, to)
        out = F.regexp_replace(out, r"(.)\1+", "$1")
        return F.regexp_replace(out, "(?<=.)0", "")

    return each(one)


def keyword_marker(words: list[str], step: Step) -> Step:
    """step for all tokens but words."""
    return each(lambda x: F.when(x.isin(words), x).otherwise(F.get(step(F.array(x)), F.lit(0))))


def stemmer_override(pairs: dict[str, str], step: Step) -> Step:
    """Given stems for some words, step for all others."""

    def one(x: Column) -> Column:
        out = F.get(step(F.array(x)), F.lit(0))
        for word, stem in pairs.items():
            out = F.when(x == word, stem).otherwise(out)
        return out

    return each(one)


def pattern_capture(patterns: list[str], whole: bool = True) -> Step:
    """Every group of every match of the patterns, besides the token if whole."""

    def one(x: Column) -> Column:
        got = [F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in patterns]
        parts = F.concat(*([F.array(x)] if whole else []), *got)
        return F.filter(F.array_distinct(parts), lambda g: g != "")

    return lambda a: F.flatten(F.transform(a, one))


def word_delimiter(whole: bool = False) -> Step:
    """Tokens cut at punctuation, at changes of case and between letters and digits; a possessive 's goes."""

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x, "['’]s$", "")
        parts = F.filter(F.split(bare, r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"), lambda p: p != "")
        return F.when((F.size(parts) > 1) & F.lit(whole), F.concat(F.array(x), parts)).otherwise(parts)

    return lambda a: F.flatten(F.transform(a, one))


def delimited_payload(sep: str = "|") -> Step:
    """Tokens without what follows the separator; see payloads() for that."""
    return each(lambda x: F.substring_index(x, sep, 1))


def payloads(a: Column, sep: str = "|") -> Column:
    """The numbers that follow the separator, null where there is none."""
    return F.transform(a, lambda x: F.when(x.contains(sep), F.substring_index(x, sep, -1).try_cast("double")))


def min_hash(hashes: int = 1, buckets: int = 512) -> Step:
    """For each hash function and bucket the least value of any token, as hex texts."""

    def step(a: Column) -> Column:
        def least(i: int) -> Column:
            values = F.transform(a, lambda x: F.xxhash64(F.lit(i), x))
            slots = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.pmod(v, F.lit(buckets)))))
            return F.transform(slots, lambda b: F.lower(F.hex(F.array_min(F.filter(values, lambda v: F.pmod(v, F.lit(buckets)) == b)))))

        return F.flatten(F.array(*[least(i) for i in range(hashes)]))

    return step


def multiplexer(*steps: Step) -> Step:
    """The tokens of several filters side by side, each once."""
    return lambda a: F.array_distinct(F.concat(a, *[s(a) for s in steps]))


def remove_duplicates() -> Step:
    """Tokens equal to the one just before go."""
    return lambda a: F.filter(a, lambda x, i: (i == 0) | ~F.get(a, F.greatest(i - 1, F.lit(0))).eqNullSafe(x))


#: Characters and what stands for each; those beyond the second text's end are left out.
FORMS = {
    "arabic": ("آأإىة" + "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0640", "اااي" + "ه"),
    "persian": ("یےکۀہ", "ييكهه"),
    "german": ("äöüß", "aous"),
    "scandinavian": ("äöÄÖ", "æøÆØ"),
    "turkish": ("İI", "iı"),
}


def normalize(form: str) -> Step:
    """Letters brought to one form: one of FORMS, width (full-width ASCII to plain) or digits (of other scripts to 0-9)."""
    if form == "width":
        plain = "".join(map(chr, range(0x21, 0x7F)))
        return each(lambda x: F.translate(x, "".join(chr(ord(c) + 0xFEE0) for c in plain), plain))
    if form == "digits":
        zeros = (0x660, 0x6F0, 0x966, 0x9E6, 0xE50, 0xFF10)
        return each(lambda x: F.translate(x, "".join(chr(z + d) for z in zeros for d in range(10)), "0123456789" * len(zeros)))
    return each(lambda x: F.translate(x, *FORMS[form]))


def bigrams_of_ideographs() -> Step:
    """As a tokenizer: words of other scripts whole and lower-cased, runs of Chinese, Japanese and Korean characters by overlapping pairs."""
    han = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

    def step(t: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(t), F.lit(rf"{han}+|[\p{{L}}\p{{N}}_&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}]]+"), F.lit(0))

        def one(x: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))
            return F.when(x.rlike(f"^{han}{{2,}}$"), pairs).otherwise(F.array(x))

        return F.flatten(F.transform(runs, one))

    return step
