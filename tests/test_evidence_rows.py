"""A quote is grouped once, not for each end of its triples."""

from weftgraph.operators import triples


def _rows(spark):
    rows = [(f"a{i % 3}", f"p{i % 2}", f"b{i % 4}" if i % 5 else None, f"quote {i // 2}", str(i % 2), i // 4, f"L{i % 3}", f"L{i % 4}") for i in range(24)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string, evidence_quote string, community_id string, chunk_id int, subject_label string, object_label string")


def test_evidence_holds_both_ends_in_one_row(spark):
    out = triples.evidence_groups(_rows(spark))
    want = {}
    for r in _rows(spark).collect():
        e, p = want.setdefault((r.evidence_quote, r.community_id, str(r.chunk_id)), (set(), set()))
        e |= {x for x in (r.subject, r.object) if x is not None}
        p.add(r.predicate)
    assert {(r.evidence_quote, r.community_id, r.chunk_id): (r.entities, r.predicates) for r in out.collect()} == {k: (sorted(e), sorted(p)) for k, (e, p) in want.items()}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
