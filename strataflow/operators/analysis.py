"""Text analysis as composable steps: character filters, tokenizers and token filters, each a column expression.

A chain is what CREATE ANALYZER declares: char filters on the text, one tokenizer, token filters on the array."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stemming import porter

Step = Callable[[Column], Column]

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"

# on the text


def html_strip() -> Step:
    def step(t: Column) -> Column:
        t = F.regexp_replace(t, "<[^>]*>", " ")
        for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
            t = F.replace(t, F.lit(name), F.lit(char))
        return t

    return step


def mapping(pairs: dict[str, str]) -> Step:
    def step(t: Column) -> Column:
        for a, b in pairs.items():
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    return step


def pattern_replace(pattern: str, to: str) -> Step:
    """On a text, or on each token if it is among the token filters."""
    return lambda t: F.regexp_replace(t, pattern, to)


# to tokens


def split_on(pattern: str) -> Step:
    return lambda t: F.array_remove(F.split(t, pattern), "")


standard = lambda: split_on(r"[^\p{L}\p{N}_]+")
letter = lambda: split_on(r"[^\p{L}]+")
whitespace = lambda: split_on(r"\s+")
pattern = split_on


def classic() -> Step:
    """Words with inner dots, apostrophes and addresses kept whole."""
    return lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+(?:[.@'-][\p{L}\p{N}_]+)*"), F.lit(0))


uax_url_email = lambda: (lambda t: F.regexp_extract_all(t, F.lit(r"[a-zA-Z]+://[^\s]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\p{L}\p{N}_]+"), F.lit(0)))
keyword = lambda: (lambda t: F.array(t))


def char_group(chars: str) -> Step:
    return split_on("[" + "".join("\\" + c for c in chars) + "]+")


def simple_pattern(p: str) -> Step:
    return lambda t: F.regexp_extract_all(t, F.lit(p), F.lit(0))


def path_hierarchy(sep: str = "/") -> Step:
    def step(t: Column) -> Column:
        parts = F.split(t, "\\Q" + sep + "\\E")
        return F.filter(F.transform(parts, lambda x, i: F.array_join(F.slice(parts, 1, i + 1), sep)), lambda x: x != "")

    return step


def grams(least: int, most: int, edge: bool = False) -> Step:
    """n-grams of a text as a tokenizer; as a token filter see ngram and edge_ngram."""

    def of(x: Column) -> Column:
        sizes = F.sequence(F.lit(least), F.lit(most))
        starts = F.lit(1) if edge else None
        each = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(starts if edge else F.char_length(x) - n + 1, F.lit(1))), lambda i: F.substr(x, i, n)))
        return F.array_distinct(F.filter(F.flatten(each), lambda g: F.char_length(g) >= least))

    return of


# on tokens


def each(f: Step) -> Step:
    return lambda a: F.transform(a, f)


lowercase = lambda: each(F.lower)
uppercase = lambda: each(F.upper)
trim = lambda: each(lambda x: F.trim(x))  # noqa: E731  trim takes a second argument, which transform would give it
reverse = lambda: each(F.reverse)
ascii_folding = lambda: each(lambda x: F.translate(x, ACCENTED, PLAIN))
token_pattern_replace = lambda p, to: each(pattern_replace(p, to))


def ngram(least: int, most: int) -> Step:
    return lambda a: F.flatten(F.transform(a, grams(least, most)))


def edge_ngram(least: int, most: int) -> Step:
    return lambda a: F.flatten(F.transform(a, grams(least, most, True)))


def length(least: int = 0, most: int = 1 << 30) -> Step:
    return lambda a: F.filter(a, lambda x: F.char_length(x).between(least, most))


def limit(n: int) -> Step:
    return lambda a: F.slice(a, 1, n)


def unique() -> Step:
    return F.array_distinct


def stop(words: list[str]) -> Step:
    return lambda a: F.filter(a, lambda x: ~x.isin(words))


def keep(words: list[str]) -> Step:
    return lambda a: F.filter(a, lambda x: x.isin(words))


def truncate(n: int) -> Step:
    return each(lambda x: F.substr(x, F.lit(1), F.lit(n)))


def elision(articles: list[str]) -> Step:
    return each(lambda x: F.regexp_replace(x, "^(?i:" + "|".join(articles) + ")['’]", ""))


def apostrophe() -> Step:
    return each(lambda x: F.regexp_replace(x, "['’].*$", ""))


def shingle(n: int, sep: str = " ") -> Step:
    """Every n consecutive tokens joined, besides the tokens themselves."""

    def step(a: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), sep))
        return F.when(F.size(a) >= n, F.concat(a, joined)).otherwise(a)

    return step


def common_grams(words: list[str]) -> Step:
    """Tokens, and pairs of neighbours of which one is common, joined by _."""

    def step(a: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.when(F.get(a, i - 1).isin(words) | F.get(a, i).isin(words), F.concat_ws("_", F.get(a, i - 1), F.get(a, i))))
        return F.when(F.size(a) > 1, F.concat(a, F.filter(pairs, lambda x: x.isNotNull()))).otherwise(a)

    return step


def synonyms(groups: dict[str, list[str]]) -> Step:
    def step(a: Column) -> Column:
        table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in [k, *v]]))])
        return F.flatten(F.transform(a, lambda x: F.coalesce(F.element_at(table, x), F.array(x))))

    return step


def compound(words: list[str]) -> Step:
    """Dictionary words inside a token, besides the token."""

    def step(a: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.concat(F.array(x), F.filter(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w) & (x != w)))))

    return step


def fingerprint(sep: str = " ") -> Step:
    """One token: the sorted distinct ones joined."""
    return lambda a: F.array(F.array_join(F.array_sort(F.array_distinct(a)), sep))


#: Endings, each with what takes its place.
SUFFIXES = {
    "english": ["ational>ate", "fulness>ful", "iveness>ive", "ization>ize", "ingly>", "edly>", "sses>ss", "ies>y", "ing>", "ed>", "ly>", "ss>ss", "s>"],
    "german": ["erinnen>", "innen>", "heiten>heit", "keiten>keit", "ungen>ung", "ern>", "en>", "er>", "es>", "em>", "e>", "n>", "s>"],
    "french": ["issements>", "issement>", "ements>", "ement>", "ations>", "ation>", "euses>", "euse>", "eaux>eau", "aux>al", "es>", "s>", "e>"],
    "spanish": ["amientos>", "amiento>", "aciones>", "ación>", "mente>", "ando>", "iendo>", "es>", "os>", "as>", "s>", "o>", "a>"],
}


def light_stem(language: str, least: int = 3) -> Step:
    """Takes off the longest known ending that leaves at least so many letters. A light stemmer, not any algorithm by name."""

    def one(x: Column) -> Column:
        out = x
        for rule in reversed(SUFFIXES[language]):
            old, new = rule.split(">")
            out = F.when(x.endswith(old) & (F.char_length(x) - len(old) >= least), F.concat(F.substr(x, F.lit(1), F.char_length(x) - len(old)), F.lit(new))).otherwise(out)
        return out

    return each(one)


#: Endings of inflection by language, for light stemming where no rules stand above.
ENDINGS = {
    "armenian": ["ներից", "ներով", "ներ", "ում", "ից", "ով"], "basque": ["aren", "etan", "ekin", "ak", "ek", "an"], "brazilian": ["ções", "mente", "ção", "ando", "endo", "es", "os", "as"], "bulgarian": ["ията", "ите", "ата", "ове", "ът", "та", "то", "и"],
    "catalan": ["cions", "ment", "ció", "ant", "es", "os", "a"], "czech": ["ování", "ého", "ých", "ách", "ami", "ou", "y"], "danish": ["erne", "ene", "ende", "er", "en", "et", "e"], "dutch": ["heden", "ingen", "ing", "en", "je", "e", "s"],
    "finnish": ["issa", "illa", "ista", "ssa", "lla", "den", "t"], "galician": ["cións", "mente", "ción", "ando", "es", "os", "as"], "greek": ["ους", "ων", "ες", "οι", "ος", "ας", "η"], "hungarian": ["okban", "ekben", "ban", "ben", "nak", "nek", "ok", "ek"],
    "indonesian": ["kannya", "kan", "nya", "lah", "kah", "an", "i"], "irish": ["eanna", "anna", "acht", "adh", "igh", "a"], "italian": ["zioni", "mente", "zione", "ando", "endo", "i", "e", "o", "a"], "latvian": ["iem", "ajam", "as", "us", "ām", "s", "a"],
    "lithuanian": ["iams", "uose", "ose", "ams", "as", "ų", "ai"], "norwegian": ["hetene", "heten", "ene", "ande", "er", "en", "et", "a"], "portuguese": ["ções", "mente", "ção", "ando", "indo", "es", "os", "as"], "romanian": ["ilor", "ului", "elor", "ul", "ea", "le", "i"],
    "russian": ["ование", "ами", "ого", "ыми", "ах", "ов", "ый", "ы"], "swedish": ["heterna", "arna", "erna", "orna", "ande", "ar", "er", "en"], "turkish": ["larından", "lerinden", "ların", "lerin", "lar", "ler", "da", "de"],
}


def strip_endings(language: str, least: int = 3) -> Step:
    """Takes off the longest of a language's ENDINGS that leaves at least so many letters."""

    def one(x: Column) -> Column:
        out = x
        for end in sorted(ENDINGS[language], key=len):
            out = F.when(x.endswith(end) & (F.char_length(x) - len(end) >= least), F.substr(x, F.lit(1), F.char_length(x) - len(end))).otherwise(out)
        return out

    return each(one)


@dataclass(frozen=True)
class Chain:
    chars: list[Step] = field(default_factory=list)
    tokenizer: Step = field(default_factory=standard)
    filters: list[Step] = field(default_factory=list)

    def tokens(self, text: Column) -> Column:
        for f in self.chars:
            text = f(text)
        out = self.tokenizer(text)
        for f in self.filters:
            out = f(out)
        return out


#: Common words by language.
STOPS = {
    "english": ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"],
    "german": ["der", "die", "das", "und", "ein", "eine", "einen", "in", "im", "ist", "nicht", "mit", "von", "zu", "den", "dem", "des", "auf", "für", "als", "auch", "es", "an", "er", "sie"],
    "french": ["le", "la", "les", "un", "une", "de", "des", "du", "et", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "aux", "ne", "pas", "ce", "il", "elle"],
    "spanish": ["el", "la", "los", "las", "un", "una", "de", "del", "y", "en", "es", "que", "por", "para", "con", "no", "se", "su", "al", "lo", "como"],
}

ANALYZERS: dict[str, Chain] = {
    "standard": Chain(filters=[lowercase()]), "simple": Chain(tokenizer=letter(), filters=[lowercase()]), "whitespace": Chain(tokenizer=whitespace()), "keyword": Chain(tokenizer=keyword()),
    "stop": Chain(tokenizer=letter(), filters=[lowercase(), stop(STOPS["english"])]), "pattern": Chain(tokenizer=split_on(r"\W+"), filters=[lowercase()]), "porter": Chain(filters=[lowercase(), stop(STOPS["english"]), porter()]), "fingerprint": Chain(filters=[lowercase(), ascii_folding(), fingerprint()]),
    **{k: Chain(tokenizer=classic() if k == "french" else standard(), filters=[*([elision(["l", "d", "j", "qu", "n", "s", "c", "m", "t"])] if k == "french" else []), lowercase(), stop(v), light_stem(k)]) for k, v in STOPS.items()},
}


def language(name: str, stops: list[str] | None = None, normal: Step | None = None) -> Chain:
    """An analyzer of a language: letters lower-cased and brought to one form, elided articles and common words left out
    (the caller's, as lists of them are data; see frequent()), endings taken off."""
    articles = {"catalan": ["l", "d", "m", "n", "s", "t"], "irish": ["d", "m", "b"], "italian": ["c", "l", "all", "dall", "dell", "nell", "sull", "un", "d"]}.get(name)
    steps = [elision(articles)] if articles else []
    if name == "turkish":
        steps += [each(lambda x: F.regexp_replace(x, "['’].*$", "")), each(lambda x: F.translate(x, "İI", "iı"))]
    steps += [lowercase()]
    if name == "greek":
        steps += [each(lambda x: F.translate(x, "άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ"))]
    steps += [normal] if normal else []
    steps += [stop(stops)] if stops else []
    return Chain(tokenizer=classic() if articles or name == "turkish" else standard(), filters=[*steps, *([strip_endings(name)] if name in ENDINGS else [])])


def frequent(df: DataFrame, text: str, n: int, chain: Chain | None = None) -> list[str]:
    """The n most frequent tokens of a column (ties by name), as stop words learned from the texts at hand."""
    words = df.select(F.explode((chain or ANALYZERS["standard"]).tokens(F.col(text))).alias("w")).groupBy("w").count()
    return [r.w for r in words.orderBy(F.col("count").desc(), "w").limit(n).collect()]  # n rows


def create_analyzer(name: str, chain: Chain) -> None:
    ANALYZERS[name] = chain


ANALYZERS |= {k: language(k) for k in ENDINGS}


def drop_analyzer(name: str) -> None:
    del ANALYZERS[name]
