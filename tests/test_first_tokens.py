"""The first tokens of a text against all of them."""

from pyspark.sql import functions as F

from weftgraph.functions.text import first_tokens, sparse_tokens
from weftgraph.plans import views

ODD = ["", " ", "a", "a b", "a b c", "  A--b__c D e", "ÉTÉ İstanbul ΑΣ'Α ΟΔΟΣ", "คำ ไทย กา ๙", "x‌y z1 z2 z3", "é äb ½ c d", "\t١٢ 中文 ß", "...a", "a.b.c.", "²³ m² n", "😀 a 😀b c\U0001d400 d", "_ _ _ _", None]


def test_first_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for n in (1, 3):
        for r in rows.select("t", sparse_tokens(F.col("t")).alias("all"), first_tokens(F.col("t"), n).alias("first")).collect():
            assert r.first == (r.all[:n] if r.all is not None and len(r.all) >= n else None), r


def test_triples_read_no_more_than_three_tokens(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id int, text string")
    found = views.triples_of(docs)
    assert {(r.doc_id, r.subject, r.predicate, r.object, r.evidence_quote) for r in found.collect()} == {(i, *r.all[:3], r.text) for i, r in enumerate(docs.select("text", sparse_tokens(F.col("text")).alias("all")).collect()) if r.all and len(r.all) >= 3}
    assert "{3}" in found._jdf.queryExecution().optimizedPlan().toString()
