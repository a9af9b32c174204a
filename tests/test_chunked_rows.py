"""Chunks that answers put are cut in the document's row."""

from weftgraph.operators import chunking


def test_answers_cut_their_own_row(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (1, "x\ny"), (2, "# h\nz\n# i\nw")], "doc_id int, text string")
    found = chunking.chunked(docs, lambda numbered: [] if "#" in numbered else [(k, k + 1) for k in range(1, numbered.count("\n") + 2, 2)])
    own = {(r.doc_id, r.chunk_id, r.content, r.start_line, r.end_line) for r in found.collect()}
    assert own == {(1, 1, "a\nb", 1, 2), (1, 2, "c\nd", 3, 4), (1, 1, "x\ny", 1, 2), (2, 1, "# h\nz", 1, 2), (2, 2, "# i\nw", 3, 4)} and found.count() == 5
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
