"""The whole job where ids repeat and where context follows."""

from strataflow.llm import pii, simhash


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = "one text about rivers and hills and the sea", "a wholly different story of trains in the night", "third words that nothing else here resembles at all"
    rows = [(5, a), (5, b), (5, b), (3, a), (7, b), (5, c), (9, None), (9, "x"), (None, a)]
    assert min((simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() for x, y in ((a, b), (a, c), (b, c))) > simhash.RADIUS
    for ids in ("long", "string"):
        docs = spark.createDataFrame([(None if i is None else str(i) if ids == "string" else i, t, "d") for i, t in rows], f"doc_id {ids}, text string, digest string")
        for n in (4,):
            out = simhash.dedupe(docs.repartition(n))
            assert out.columns == docs.columns
            assert sorted(((r.doc_id or "") and int(r.doc_id) or 0, r.text or "") for r in out.collect()) == sorted([(0, a), (3, a), (5, b), (5, c), (9, ""), (9, "x")])


def test_context_may_follow(spark):
    texts = ["123-45-6789 is my SSN", "SSN 123-45-6789", "é 123-45-6789", "123-45-6789" + " " * 37 + "ssn", "123-45-6789" + " " * 38 + "ssn", "mail a@b.cd now", "a@b.cd is my mail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[x.kind], round(x.score, 2)) for x in r.pii] for r in pii.detect(df).collect()}
    social, email = [("national_id", 0.55)], [("email", 1.0)]
    assert got == {0: social, 1: social, 2: [], 3: social, 4: [], 5: email, 6: email}
    assert pii.redact(df).where("doc_id = 0").first().text == "<NATIONAL_ID> is my SSN"
