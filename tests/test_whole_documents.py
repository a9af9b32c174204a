"""The document queries leave no line out."""

import random
import textwrap

from weftgraph.operators import chunking, diagnostics
from weftgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_range_chunks_hold_every_line(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    chunks = {}
    for r in QUERIES["d08_range_chunks_whole"](spark, SF).collect():
        chunks.setdefault(r.doc_id, []).append(r)
    assert any(t.count("\n") > 5 for t in docs.values())
    for k, t in docs.items():
        lines = t.split("\n")
        want = [(a + 1, min(a + 5, len(lines)), "\n".join(lines[a : a + 5]).strip()) for a in range(0, len(lines), 5)]
        assert sorted((r.start_line, r.end_line, r.content) for r in chunks.get(k, [])) == [w for w in want if w[2]]


def test_chunk_ranges_reach_the_last_line(spark):
    n = {r.doc_id: r.text.count("\n") + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    covered = {}
    for r in QUERIES["j05_chunk_ranges_whole"](spark, SF).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end + 1))
    assert covered == {k: set(range(1, m + 1)) for k, m in n.items()}


def test_long_lines_are_wrapped(spark):
    words = " ".join(f"word{k}-x" for k in range(60))
    texts = {1: f"short\n  {words}\n" + " " * 200 + "\n" + "y" * 150 + "\nend", 2: None, 3: "", 4: "z" * 120}
    got = {}
    for r in chunking.wrapped_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[3] == [""] and got[4] == ["z" * 120] and 2 not in got
    long = got[1][1:-2]
    assert got[1][0] == "short" and got[1][-2:] == ["y" * 150, "end"] and " ".join(x.strip() for x in long) == words
    assert len(long) > 3 and all(x.startswith("  word") and len(x) <= 120 for x in long)
    assert all(len(a) + 1 + len(b.split()[0]) > 120 for a, b in zip(long, long[1:]))
    assert QUERIES["d02_wrapped_lines"](spark, SF).count() > QUERIES["d02_lines"](spark, SF).count()


def test_wrapping_and_section_sizes_by_hand(spark):
    rng = random.Random(1)
    parts = [" ", "  ", "\t", "a", "bb-c", "word", "x" * 25, "\r", "é", " w", " of", "     "]
    docs = dict(enumerate("\n".join("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3)) for _ in range(150)))
    got = {}
    for r in chunking.wrapped_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 20).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for k, t in docs.items():
        want = []
        for line in t.split("\n"):
            long = textwrap.wrap(line, 20, subsequent_indent=" " * (len(line) - len(line.lstrip())), break_long_words=False, break_on_hyphens=False)
            want += [line] if len(line) <= 20 else long
        assert got.get(k, []) == want
    shapes = {1: (1, 5), 2: (100, 9), 3: (101, 9), 4: (1000, 100), 5: (1049, 300), 6: (3000, 500), 7: (999, 2000), 8: (200, 4000)}
    rows = [(k, "\n".join(["y" * m] * n)) for k, (n, m) in shapes.items()]
    sizes = {r.doc_id: r.size for r in chunking.section_sizes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (n, m) in shapes.items():
        tried = [min(n, 1000)]
        while tried[-1] > 100:
            tried.append(int(tried[-1] * 0.8))
        fit = [s for s in tried if s > 100 and (s * m + s - 1) // 4 + 1000 <= 50_000]
        assert sizes[k] == (min(fit[0] + 50, n) if fit else 100)


def test_triples_extremes(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 0, 5), (2, 1, 0)], "doc_id long, chunk_id int, n_triples long")
    got = sorted(tuple(r) for r in diagnostics.triples_extremes(df).collect())
    assert got == [("greatest", 2, 0, 5, 1.75), ("least", 1, 1, 0, 1.75), ("least", 2, 1, 0, 1.75)]
    same = diagnostics.triples_extremes(df.where("n_triples = 2")).collect()
    assert sorted(r.extreme for r in same) == ["greatest", "least"]


def test_wrapped_lines_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a\n" + "word " * 60), (2, None), (3, "")], "doc_id long, text string")
    out = chunking.wrapped_lines(docs)
    assert [(r["line_no"], len(r["text"])) for r in out.where("doc_id = 1").orderBy("line_no").collect()] == [(0, 1), (1, 119), (2, 119), (3, 59)]
    assert [tuple(r) for r in out.where("doc_id <> 1").collect()] == [(3, 0, "")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
