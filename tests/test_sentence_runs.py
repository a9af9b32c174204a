"""Sentence coverage in rows and run by run, against loops."""

import pytest

from weftgraph.operators import diagnostics

SENTENCES = [(1, "One two three  four five"), (1, "alone here"), (1, "nothing is like this at all"), (1, " "), (2, "one two three four"), (2, "b c"), (3, "no quotes of this key"), (None, "one two three four")]
QUOTES = [(1, "zero one TWO three"), (1, "zero one TWO three"), (1, "not alone here now"), (2, "a b c d e f g"), (2, "x"), (None, "one two three four"), (4, "of no sentence")]


@pytest.mark.parametrize("most", [4096, 4, 0])
def test_covered_sentences(spark, monkeypatch, most):
    monkeypatch.setattr(diagnostics, "RUNS", most)
    out = diagnostics.sentence_coverage(spark.createDataFrame(SENTENCES, "doc_id long, text string"), spark.createDataFrame(QUOTES, "doc_id long, evidence_quote string"))
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}
    want = {}
    for key, text in SENTENCES:
        t, own = text.lower().strip(), [q.lower() for k, q in QUOTES if k == key is not None]
        if t:
            hit = any(runs(t.split()) & runs(q.split()) for q in own) if len(t.split()) > 3 else any(t in q for q in own)
            n = want.setdefault(key, [0, 0])
            n[0] += 1
            n[1] += hit
    assert {r.doc_id: [r.n_sentences, r.n_covered] for r in out.collect()} == want
    if most == 4096:
        assert "_k#" not in out._jdf.queryExecution().optimizedPlan().toString()
