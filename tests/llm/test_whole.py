"""Corpus operators that once left work out."""

from tessera.llm import pii, warc


def test_warc_tells_payloads_of_one_page_id_apart(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "x"), (3, "d", "y"), (3, "e", "other")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"] or 0, r["html"]) for r in warc.read(warc.write(pages)).collect())
    assert got == [(1, "a", "response", 0, "x"), (2, "b", "response", 0, "y"), (3, "c", "revisit", 1, None), (3, "d", "revisit", 2, None), (3, "e", "response", 0, "other")]


def test_secrets_of_letters_only_are_replaced(spark):
    texts = ["key AKIA" + "ABCDEFGHIJKLMNOP", "sum " + "abcdefab" * 4, "plain words"]
    out = [r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert out[0] != texts[0] and out[1] != texts[1] and out[2] == texts[2]
