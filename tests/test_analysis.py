"""Analyzer chains and the forms of MATCH."""

import pytest
from pyspark.sql import functions as F

from strataflow.operators import analysis as An
from strataflow.operators import textsearch as T


def tokens(spark, chain, text):
    return spark.createDataFrame([(text,)], "t string").select(chain.tokens(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("chain", "text", "want"),
    [
        (An.Chain([An.html_strip()], An.standard(), [An.lowercase()]), "<b>A &amp; B</b>", ["a", "b"]),
        (An.Chain(tokenizer=An.path_hierarchy()), "/a/b", ["/a", "/a/b"]),
        (An.Chain(tokenizer=An.classic()), "it's a.b@c.d x", ["it's", "a.b@c.d", "x"]),
        (An.Chain(tokenizer=An.uax_url_email()), "see http://x.y/z or a@b.c", ["see", "http://x.y/z", "or", "a@b.c"]),
        (An.Chain(filters=[An.ngram(2, 2)]), "abc", ["ab", "bc"]), (An.Chain(filters=[An.edge_ngram(1, 2)]), "abc", ["a", "ab"]), (An.Chain(filters=[An.shingle(2)]), "a b c", ["a", "b", "c", "a b", "b c"]),
        (An.Chain(filters=[An.common_grams(["the"])]), "of the man", ["of", "the", "man", "of_the", "the_man"]), (An.Chain(filters=[An.ascii_folding(), An.unique(), An.length(2, 9)]), "é été ete", ["ete"]),
        (An.Chain(filters=[An.synonyms({"car": ["auto"]})]), "a car", ["a", "car", "auto"]), (An.Chain(filters=[An.compound(["haus", "tür"])]), "haustür", ["haustür", "haus", "tür"]),
        (An.ANALYZERS["english"], "The cities running", ["city", "runn"]), (An.ANALYZERS["french"], "L'eau des ruisseaux", ["eau", "ruisseau"]), (An.ANALYZERS["fingerprint"], "b A b", ["a b"]),
        (An.Chain(tokenizer=An.char_group("-,")), "a-b,c", ["a", "b", "c"]), (An.Chain([An.mapping({":)": "happy"})], An.whitespace(), [An.truncate(3), An.reverse()]), "so :)", ["os", "pah"]),
    ],
)
def test_chains(spark, chain, text, want):
    assert tokens(spark, chain, text) == want


def test_match_forms(spark):
    df = spark.createDataFrame([("the quick brown fox",)], "t string")
    t = F.col("t")
    forms = {"a": T.match(t, "quikc", fuzziness=2), "b": T.match(t, "quikc"), "c": T.match(t, "the fox", kind="phrase", slop=2), "d": T.match(t, "the fox", kind="phrase", slop=1), "e": T.match(t, "quick bro", kind="phrase_prefix"), "f": T.match(t, "fox", analyzer=An.ANALYZERS["english"])}
    assert df.select(*[c.alias(k) for k, c in forms.items()]).first().asDict() == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": True}


def test_registry():
    An.create_analyzer("mine", An.Chain(filters=[An.uppercase()]))
    An.drop_analyzer("mine")
    assert "mine" not in An.ANALYZERS


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [("russian", "Новыми домами", ["нов", "дом"]), ("greek", "Οι άνθρωποι", ["οι", "ανθρωπ"]), ("turkish", "İstanbul'da evler IŞIKLAR", ["istanbul", "evler", "ışık"]), ("italian", "L'azione delle nazioni", ["azion", "dell", "nazion"]), ("swedish", "bilarna hundar", ["bil", "hund"]), ("dutch", "waarheden boeken", ["waar", "boek"])],
)
def test_languages(spark, name, text, want):
    from strataflow.operators import analysis as An

    assert spark.createDataFrame([(text,)], "t string").select(An.language(name).tokens(F.col("t")).alias("x")).first().x == want


def test_stops_from_the_texts(spark):
    from strataflow.operators import analysis as An

    df = spark.createDataFrame([("a b a c",), ("a b d",)], "t string")
    assert An.frequent(df, "t", 2) == ["a", "b"]
    assert df.select(An.language("danish", An.frequent(df, "t", 2)).tokens(F.col("t")).alias("x")).collect()[0].x == ["c"]
