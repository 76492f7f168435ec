"""String functions with PostgreSQL-like semantics, as Column builders over JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column


def lit(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def full_match(s: Column, pattern: str, ignore_case: bool = False) -> Column:
    """~ and ~*: the whole string has to match, where rlike would search."""
    return s.rlike(("(?i)" if ignore_case else "") + f"^(?:{pattern})$")


def substr(s: Column, start: Column | int, count: Column | int | None = None) -> Column:
    """From a 1-based start; a start below 1 counts as 1 and uses up no length."""
    at = F.greatest(lit(start), F.lit(1))
    return F.substr(s, at) if count is None else F.substr(s, at, F.greatest(lit(count), F.lit(0)))


def substr_pattern(s: Column, pattern: str) -> Column:
    """The first group of the first match, or the match if there is no group; null if nothing matches."""
    group = 1 if _groups(pattern) else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def concat(*parts: Column) -> Column:
    """concat(): nulls count as empty."""
    return F.concat(*[F.coalesce(lit(p).cast("string"), F.lit("")) for p in parts])


def concat_op(a: Column, b: Column) -> Column:
    """The || operator: null if either side is."""
    return F.concat(a, b)


def left(s: Column, n: int) -> Column:
    """The first n characters; a negative n leaves out the last -n."""
    return F.substr(s, F.lit(1), F.lit(n)) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.char_length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """The last n characters; a negative n leaves out the first -n."""
    if n >= 0:
        return F.substr(s, F.greatest(F.char_length(s) - n, F.lit(0)) + 1)
    return F.substr(s, F.lit(1 - n))


def lpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.lpad(s, n, fill) if n > 0 else F.when(s.isNotNull(), "")


def rpad(s: Column, n: int, fill: str = " ") -> Column:
    return F.rpad(s, n, fill) if n > 0 else F.when(s.isNotNull(), "")


def trim(s: Column, chars: str = " ", side: str = "BOTH") -> Column:
    f = {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[side]
    return f(s, F.lit(chars))


def split_part(s: Column, sep: str, n: int) -> Column:
    """The n-th field from 1; '' beyond the last; fields under 1 are errors."""
    if n < 1:
        raise ValueError("the field must be at least 1")
    if not sep:
        return s if n == 1 else F.when(s.isNotNull(), "")
    return F.split_part(s, F.lit(sep), F.lit(n))


def strpos(s: Column, part: str) -> Column:
    return F.instr(s, part)


def chr_(n: Column) -> Column:
    """The character of a code point; zero, negative or too large ones raise."""
    text = F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.when((n < 1) | (n > 0x10FFFF), F.raise_error(F.lit("not a code point")).cast("string")).otherwise(text)


def initcap(s: Column) -> Column:
    return F.initcap(s)


def encode(s: Column, kind: str) -> Column:
    """Bytes of the text in base64 or hex (the bytea form keeps its \\x)."""
    return F.base64(s.cast("binary")) if kind == "base64" else F.concat(F.lit("\\x"), F.lower(F.hex(s.cast("binary"))))


def decode(s: Column, kind: str) -> Column:
    if kind == "base64":
        return F.unbase64(s).cast("string")
    return F.unhex(F.regexp_replace(s, r"^\\x", "")).cast("string")


def parse_url(s: Column) -> Column:
    """A struct of the parts; parameters is a map from a name to its values in order."""

    def part(name: str) -> Column:
        return F.try_parse_url(s, F.lit(name))

    pairs = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda x: x != "")
    pairs = F.transform(pairs, lambda x: F.struct(F.url_decode(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.when(x.contains("="), F.url_decode(F.substr(x, F.instr(x, "=") + 1))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    params = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), ":([0-9]+)$", 1)
    fields = {"scheme": part("PROTOCOL"), "userinfo": part("USERINFO"), "hostname": part("HOST"), "port": F.when(port != "", port.cast("int")), "path": part("PATH"), "query": part("QUERY"), "parameters": F.when(part("QUERY").isNotNull(), params), "fragment": part("REF")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def parse_uri(s: Column) -> Column:
    u = parse_url(s)
    return F.struct(*[u[k].alias(k) for k in ("scheme", "userinfo", "hostname", "port", "path", "query", "fragment")])


def quote_ident(s: Column) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def flags_of(pattern: str, flags: str = "") -> str:
    """pattern with flags (i, u, U, s, m, x, d) put in front, g left out."""
    inline = "".join(f for f in flags if f in "iuUsmxd")
    return f"(?{inline}){pattern}" if inline else pattern


def regexp_replace(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """Only the first match is replaced, unless flags hold g."""
    p = flags_of(pattern, flags)
    if "g" in flags:
        return F.regexp_replace(s, p, to)
    # the first match and what follows it: everything after is put back as the last group
    last = _groups(pattern) + 1
    return F.regexp_replace(s, flags_of(f"(?:{pattern})([\\s\\S]*)", flags), f"{to}${last}")


def regexp_count(s: Column, pattern: str, start: int = 1, flags: str = "") -> Column:
    if start < 1:
        raise ValueError("the start must be at least 1")
    return F.regexp_count(F.substr(s, F.lit(start)), F.lit(flags_of(pattern, flags)))


def regexp_instr(s: Column, pattern: str, start: int = 1, nth: int = 1, after: bool = False, flags: str = "") -> Column:
    """The position of the nth match from start (the one after its end if after); 0 if there is none."""
    if start < 1 or nth < 1:
        raise ValueError("positions start at 1")
    p = flags_of(pattern, flags)
    rest = F.substr(s, F.lit(start))
    got = F.regexp_extract_all(rest, F.lit(p), F.lit(0))
    gaps = F.split(rest, p, -1)
    before = F.aggregate(F.slice(gaps, 1, nth), F.lit(0), lambda a, x: a + F.char_length(x)) + F.aggregate(F.slice(got, 1, nth - 1 + after), F.lit(0), lambda a, x: a + F.char_length(x))
    return F.when(F.size(got) >= nth, before + start).otherwise(F.when(s.isNotNull(), 0))


def string_to_array(s: Column, sep: str | None, null: str | None = None) -> Column:
    """Split by a plain separator; a null separator splits into characters; '' gives no elements; elements equal to null become null."""
    if sep is None:
        parts = F.filter(F.split(s, ""), lambda x: x != "")
    elif sep == "":
        parts = F.array(s)
    else:
        parts = F.split(s, "\\Q" + sep + "\\E", -1)
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
    return parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    text = a.cast("array<string>")
    return F.array_join(text, sep) if null is None else F.array_join(text, sep, null)


def format_(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


#: PostgreSQL-style template parts and Java's.
TO_CHAR = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "AM": "a", "PM": "a", "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE", "Q": "Q"}


def to_char(ts: Column, template: str) -> Column:
    """A timestamp by a PostgreSQL-style template."""
    import re

    tokens = re.split("(" + "|".join(sorted(TO_CHAR, key=len, reverse=True)) + ")", template)
    return F.date_format(ts, "".join(TO_CHAR.get(t) or ("'" + t.replace("'", "''") + "'" if re.search("[A-Za-z']", t) else t) for t in tokens))


def to_char_number(x: Column, template: str) -> Column:
    """A number by a PostgreSQL-style template of 9, 0, D, G, S, L, PR and MI."""
    return F.to_char(x, F.lit(template))


def to_char_interval(months: Column, micros: Column, template: str) -> Column:
    """A mixed interval by a template of YYYY, MM, DD, HH24, HH12, MI, SS and MS; other characters stand for themselves."""
    import re

    day, hour, minute, second = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
    parts = {
        "YYYY": (F.floor(months / 12), 4), "MM": (months % 12, 2), "DD": (F.floor(micros / day), 2), "HH24": (F.floor(micros / hour) % 24, 2), "HH12": ((F.floor(micros / hour) + 11) % 12 + 1, 2),
        "MI": (F.floor(micros / minute) % 60, 2), "SS": (F.floor(micros / second) % 60, 2), "MS": (F.floor(micros / 1000) % 1000, 3),
    }
    tokens = [t for t in re.split("(" + "|".join(sorted(parts, key=len, reverse=True)) + ")", template) if t]
    return F.concat(*[F.lpad(parts[t][0].cast("string"), parts[t][1], "0") if t in parts else F.lit(t) for t in tokens])
