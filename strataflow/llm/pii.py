"""Personal data: expressions propose spans, checksums confirm them, context words adjust their score.

Everything runs in the JVM. A span has the score of its pattern and checksum; words within NEAR characters on either
side raise or lower it. Base kinds (email, ip, card, phone) are reported whenever they match and pass their check, with
their score; further kinds only at LEAST or above, so that context decides: a national id needs a word that speaks
for it, an account number with a right checksum goes if a word speaks against it. Null texts count as empty, empty
texts have no spans, an empty table gives no rows, long texts are read whole; spans of several kinds at one place are
all reported, by start, then kind; rows with the same text each get their own result, and other columns of the
input are left alone, whatever their names (the operator reads only the named text column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let
from .spans import Rule, folded, found

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substr(text, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc: Column, x: Column) -> Column:
        d = x.cast("int") * (acc["twice"] + 1)
        return F.struct((acc["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (1 - acc["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("twice"))
    return F.aggregate(chars(F.reverse(number)), start, step, lambda acc: acc["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an IBAN (spaces allowed) passes its mod-97 check."""
    s = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def step(acc: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(chars(turned), F.lit(0), step) == 1


def card_ok(m: Column) -> Column:
    d = digits(m)
    return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)


RULES = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
    Rule("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){11}", card_ok),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.char_length(digits(m)).between(9, 15)),
    Rule("iban", IBAN, r"[A-Z]{2}[0-9]{2}", mod97),
    Rule("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
]
BASE = 4
KINDS = [r.kind for r in RULES]
#: By kind: score without context (of pattern and checksum), words that raise it.
SCORES = {
    "email": (0.9, "mail|contact|write"), "ip": (0.6, r"\bip\b|address|host|server"), "card": (0.8, "card|visa|credit|payment|master"),
    "phone": (0.6, "phone|tel|call|mobile|fax|whatsapp"), "iban": (0.6, "iban|account|bank|konto|compte|cuenta"), "national_id": (0.2, r"\bssn\b|social security|national id|tax id"),
}
#: Words that lower the score of any kind.
AGAINST = r"\bisbn\b|serial|invoice|tracking|part (?:no|number)|order (?:no|number)|version|example|dummy"
NEAR, BONUS, LEAST = 40, 0.35, 0.5


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with the array column out of struct<start, kind, stop, match, score> (code points, stop exclusive; kind
    is a position in KINDS). An existing column of that name is replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[found(whole, r, i) for i, r in enumerate(RULES)])

    def scored(x: Column) -> Column:
        start = F.greatest(x["start"] - NEAR, F.lit(0))
        before = F.lower(F.substr(whole, start + 1, x["start"] - start))
        after = F.lower(F.substr(whole, x["stop"] + 1, F.lit(NEAR)))
        score = F.lit(0.0)
        for i, k in enumerate(KINDS):
            least, words = SCORES[k]
            score = F.when(x["kind"] == i, least + F.when(before.rlike(words) | after.rlike(words), BONUS).otherwise(0.0)).otherwise(score)
        score = score - F.when(before.rlike(AGAINST) | after.rlike(AGAINST), BONUS).otherwise(0.0)
        return F.struct(*[x[c].alias(c) for c in ("start", "kind", "stop", "match")], F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2).alias("score"))

    raw = fresh(docs, f"{out}_raw")
    with_raw = docs.withColumn(raw, spans)
    kept = F.filter(F.transform(F.col(raw), scored), lambda x: (x["kind"] < BASE) | (x["score"] >= LEAST))
    return with_raw.withColumn(out, F.when(F.size(raw) > 0, F.array_sort(kept)).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,match:string,score:double>>"))).drop(raw)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in text replaced by <KIND>; overlapping spans go together under the
    first one's name. Null texts stay null; columns and their order stay as they were."""
    name = fresh(docs, "pii")
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    whole = F.col(text)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        pieces = F.array(F.substr(whole, at + 1, x["start"] - at), F.get(marks, x["kind"]))
        return F.greatest(at, x["stop"]), F.when(x["start"] >= at, pieces).otherwise(F.array().cast("array<string>"))

    def joined(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substr(whole, done["at"] + 1))

    new = let(folded(F.col(name), F.array().cast("array<string>"), step), joined)
    return detect(docs, text, name).withColumn(text, F.when(F.size(name) > 0, new).otherwise(whole)).select(*docs.columns)
