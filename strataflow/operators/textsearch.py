"""Full-text MATCH: analyzers as column expressions, boolean, phrase and prefix forms, BM25 scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Common English words.
ENGLISH_STOPS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


@dataclass(frozen=True)
class Analyzer:
    """kind: standard, whitespace, keyword, simple, pattern, ngram, edge_ngram or path; stops: tokens left out."""

    kind: str = "standard"
    stops: list[str] = field(default_factory=list)
    pattern: str = r"\W+"
    least: int = 1
    most: int = 2
    strip_html: bool = False

    def tokens(self, text: Column) -> Column:
        t = F.regexp_replace(text, "<[^>]*>", " ") if self.strip_html else text
        if self.kind == "keyword":
            return F.array(t)
        if self.kind == "whitespace":
            parts = F.split(t, r"\s+")
        elif self.kind == "simple":
            parts = F.split(F.lower(t), r"[^\p{L}]+")
        elif self.kind == "pattern":
            parts = F.split(F.lower(t), self.pattern)
        elif self.kind == "path":
            names = F.filter(F.split(t, "/"), lambda x: x != "")
            return F.transform(names, lambda x, i: F.concat(F.lit("/"), F.array_join(F.slice(names, 1, i + 1), "/")))
        else:
            parts = F.split(F.lower(t), r"[^\p{L}\p{N}_]+")
        parts = F.array_remove(parts, "")
        if self.stops:
            parts = F.filter(parts, lambda x: ~x.isin(self.stops))
        if self.kind == "edge_ngram":
            parts = F.flatten(F.transform(parts, lambda x: F.transform(F.sequence(F.lit(self.least), F.lit(self.most)), lambda n: F.substr(x, F.lit(1), n))))
        if self.kind == "ngram":
            parts = F.flatten(F.transform(parts, lambda x: F.flatten(F.transform(F.sequence(F.lit(self.least), F.lit(self.most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x) - n + 1, F.lit(1))), lambda i: F.substr(x, i, n))))))
        return parts


ANALYZERS = {"standard": Analyzer(), "whitespace": Analyzer("whitespace"), "keyword": Analyzer("keyword"), "simple": Analyzer("simple"), "stop": Analyzer("simple", ENGLISH_STOPS), "english": Analyzer("standard", ENGLISH_STOPS), "html": Analyzer(strip_html=True)}


def terms(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^\w]+", query.lower()) if t]


def match(text: Column, query: str, operator: str = "or", kind: str = "best_fields", analyzer: Analyzer = ANALYZERS["standard"], fuzziness: int = 0, slop: int = 0) -> Column:
    """Whether text matches: by any or all of the query's terms, as a phrase, or as a phrase with a prefix at its end.
    fuzziness: edits that a term may be away; slop: other words that a phrase may hold in all. analyzer: anything with
    tokens(Column)."""
    return _matched(analyzer.tokens(text), query, operator, kind, fuzziness, slop)


def matches(text: Column, analyzer: Analyzer = ANALYZERS["standard"], **conditions: dict) -> Column:
    """struct of a boolean for each named condition, given as match()'s arguments; the text is split once for all of them."""
    one = F.transform(F.array(analyzer.tokens(text)), lambda t: F.struct(*[_matched(t, **{"operator": "or", "kind": "best_fields", "fuzziness": 0, "slop": 0, **c}).alias(k) for k, c in conditions.items()]))
    return F.get(one, F.lit(0))


def _matched(tokens: Column, query: str, operator: str, kind: str, fuzziness: int, slop: int) -> Column:
    words = terms(query)
    if not words:
        return F.lit(False)
    if kind == "phrase" and slop:
        spread = len(words) + slop
        near = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, spread), " "))
        gap = r"(?: \S+){0,%d} " % slop
        return F.exists(near, lambda x: x.rlike("^" + gap.join(words) + r"(?:\s|$)"))
    if kind in ("phrase", "phrase_prefix"):
        joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        return joined.contains(" " + " ".join(words) + (" " if kind == "phrase" else ""))
    one = [F.array_contains(tokens, w) if not fuzziness else F.exists(tokens, _near(w, fuzziness)) for w in words]
    out = one[0]
    for c in one[1:]:
        out = out & c if operator == "and" else out | c
    return out


def counted(df: DataFrame, fields: list[str], words: list[str], analyzer: Analyzer) -> DataFrame:
    """df with _len<i>, the tokens of the i-th field, and _f<i>_<k>, how often the k-th word is among them. Each text is split
    once for all its counts; a filter on these columns would be pushed down and split it again."""
    row = F.struct(
        *[
            F.get(F.transform(F.array(analyzer.tokens(F.col(c))), lambda t: F.struct(F.coalesce(F.size(t), F.lit(0)).alias("len"), *[F.coalesce(F.size(t) - F.size(F.array_remove(t, w)), F.lit(0)).alias(f"f{k}") for k, w in enumerate(words)])), F.lit(0)).alias(f"c{i}")
            for i, c in enumerate(fields)
        ]
    )
    rows = df.select(*df.columns, F.explode(F.array(row)).alias("_c"))
    return rows.select(*df.columns, *[F.col(f"_c.c{i}.{'len' if k is None else f'f{k}'}").alias(f"_len{i}" if k is None else f"_f{i}_{k}") for i in range(len(fields)) for k in (None, *range(len(words)))])


def search(df: DataFrame, text: str, query: str, analyzer: Analyzer = ANALYZERS["standard"], k1: float = 1.2, b: float = 0.75, keep: list[str] | None = None) -> DataFrame:
    """Matching rows with _score (BM25 over all rows of df). With keep only these columns are returned, and each text is
    split once: its counts are written down, then read for the corpus figures and for the scores."""
    return search_fields(df, {text: 1.0}, query, analyzer=analyzer, k1=k1, b=b, keep=keep)


def search_fields(
    df: DataFrame,
    fields: dict[str, float],
    query: str,
    kind: str = "best_fields",
    operator: str = "or",
    tie_breaker: float = 0.0,
    minimum_should_match: int = 1,
    zero_terms: str = "none",
    analyzer: Analyzer = ANALYZERS["standard"],
    k1: float = 1.2,
    b: float = 0.75,
    keep: list[str] | None = None,
) -> DataFrame:
    """MATCH over several fields with boosts: matching rows with _score.

    best_fields: the score of the best field, plus tie_breaker times those of the others; most_fields: their sum;
    cross_fields: the fields count as one, each term scored by the field where it scores best. operator 'and' asks for all
    terms (in one field, or with cross_fields in any), minimum_should_match for so many. A query without terms matches
    nothing, or with zero_terms 'all' everything with score 1. Corpus figures are one aggregated row, broadcast."""
    words = list(dict.fromkeys(terms(query)))
    columns = df.columns if keep is None else keep
    if not words:
        return df.select(*columns, F.lit(1.0).alias("_score")).where(F.lit(zero_terms == "all"))
    rows = counted(df, list(fields), words, analyzer)
    if keep is not None:
        path = scratch(df.sparkSession, "counts")
        slim = rows.select(*keep, *[c for c in rows.columns if c.startswith(("_len", "_f"))])
        slim.write.parquet(path)
        rows = df.sparkSession.read.schema(slim.schema).parquet(path)
    span = [(i, k) for i in range(len(fields)) for k in range(len(words))]
    figures = rows.agg(F.count("*").alias("_n"), *[F.avg(f"_len{i}").alias(f"_avg{i}") for i in range(len(fields))], *[F.count_if(F.col(f"_f{i}_{k}") > 0).alias(f"_d{i}_{k}") for i, k in span])

    def part(i: int, k: int) -> Column:
        f, d = F.col(f"_f{i}_{k}"), F.col(f"_d{i}_{k}")
        return F.ln(1 + (F.col("_n") - d + 0.5) / (d + 0.5)) * f / (f + k1 * (1 - b + b * F.col(f"_len{i}") / F.nullif(F.col(f"_avg{i}"), F.lit(0.0))))

    need = len(words) if operator == "and" else min(minimum_should_match, len(words))
    boosts = list(fields.values())
    here = [[F.col(f"_f{i}_{k}") > 0 for k in range(len(words))] for i in range(len(fields))]
    number = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    if kind == "cross_fields":
        any_field = [reduce(Column.__or__, [here[i][k] for i in range(len(fields))]) for k in range(len(words))]
        scores = [reduce_greatest([F.coalesce(part(i, k), F.lit(0.0)) * boosts[i] for i in range(len(fields))]) for k in range(len(words))]
        score = F.when(number(any_field) >= need, sum(scores, F.lit(0.0)))
    else:
        each = [F.when(number(here[i]) >= need, sum((F.coalesce(part(i, k), F.lit(0.0)) for k in range(len(words))), F.lit(0.0)) * boosts[i]).otherwise(0.0) for i in range(len(fields))]
        total, best = sum(each, F.lit(0.0)), reduce_greatest(each)
        score = total if kind == "most_fields" else best + tie_breaker * (total - best)
    return rows.crossJoin(F.broadcast(figures)).select(*columns, score.alias("_score")).where("_score > 0")  # one row


def reduce_greatest(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def _near(word: str, edits: int):
    return lambda x: F.levenshtein(x, F.lit(word), edits) >= 0
