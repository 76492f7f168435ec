"""Porter's stemmer against his examples and against a plain program."""

import itertools

import pytest
from pyspark.sql import functions as F

from strataflow.operators import analysis as An
from strataflow.operators import stemming

EXAMPLES = """caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|
fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|hesitanci hesit|digitizer digit|radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|
predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|
hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun|
activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|generalizations gener|oscillators oscil|say sai|by by|as as|is is|possibly possibl|geology geologi|archaeology archaeolog"""


def plain(w):
    """Letter by letter, with the measure counted."""
    if len(w) < 3:
        return w

    def cons(s, i):
        return s[i] not in "aeiou" and (s[i] != "y" or i == 0 or not cons(s, i - 1))

    def kinds(s):
        return "".join("c" if cons(s, i) else "v" for i in range(len(s)))

    def m(s):
        return "".join(k for k, _ in itertools.groupby(kinds(s))).count("vc")

    def double(s):
        return len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)

    def short(s):
        return kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def longest(s, ends):
        return max((e for e in ends if s.endswith(e)), key=len, default=None)

    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif (e := longest(w, ["ed", "ing"])) and "v" in kinds(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w):
            w = w if w[-1] in "lsz" else w[:-1]
        elif m(w) == 1 and short(w):
            w += "e"
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (stemming.DOUBLE, stemming.FURTHER):
        e = longest(w, table)
        if e and m(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = longest(w, stemming.LAST)
    if e and m(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


@pytest.fixture(scope="module")
def stems(spark):
    def of(words):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        return {r.w: r.s for r in df.select("w", stemming.porter_stem(F.col("w")).alias("s")).collect()}

    return of


def test_examples(stems):
    want = dict(x.split() for x in EXAMPLES.replace("\n", "").split("|"))
    assert stems(want) == want
    assert {w: plain(w) for w in want} == want


def test_against_the_plain_program(spark, stems, folder):
    bases = ["b", "y", "yy", "ab", "tr", "troubl", "sky", "enjoy", "byy", "oat", "fizz", "hopp", "fil", "sayyy", "crue", "été", "x1", "controll", "adopt", "rela", "syzyg", "vowy"]
    ends = ["", "s", "ss", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", "ated", "bling", "izing", "ingly", *stemming.DOUBLE, *stemming.FURTHER, *stemming.LAST]
    words = {a + b for a in bases for b in ends} | {a + b + c for a in bases for b in ends for c in ("s", "ed", "e")}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words |= {r.w for r in docs.select(F.explode(An.ANALYZERS["standard"].tokens(F.col("text"))).alias("w")).distinct().collect()}
    got = stems(words)
    assert {w: got[w] for w in words} == {w: plain(w) for w in words}


def test_edges(spark, stems):
    assert stems([None, "", "a", "Running", "ss"]) == {None: None, "": "", "a": "a", "Running": "Running", "ss": "ss"}
    assert spark.range(1).select(An.ANALYZERS["porter"].tokens(F.lit("The Ponies were running")).alias("x")).first().x == ["poni", "were", "run"]
