"""Readers, writers, schema rules, communities and streams on small inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import answers, communities, schema, triples
from weftgraph.queries import RULES
from weftgraph.sources import documents, reports
from weftgraph.streaming import ingest

W = 'xmlns:w="w"'
RELS = '<Relationships><Relationship Id="r1" Target="{a}"/><Relationship Id="r2" Target="{b}"/></Relationships>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_office_pages(spark):
    docx = packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>สาม</w:t></w:r></w:p></w:body></w:document>"})
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody>{}</p:txBody></p:sp></p:sld>'
    pptx = packed({"ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldId id="9" r:id="r2"/><p:sldId id="8" r:id="r1"/></p:presentation>', "ppt/_rels/presentation.xml.rels": RELS.format(a="slides/s1.xml", b="slides/s2.xml"), "ppt/slides/s1.xml": slide.format(""), "ppt/slides/s2.xml": slide.format("<a:p><a:t>a</a:t></a:p><a:p><a:t>b</a:t></a:p>")})
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.50</v></c></row><row><c r="A2"/></row><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    xlsx = packed({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet r:id="r1"/><sheet r:id="r2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELS.format(a="worksheets/a.xml", b="/xl/worksheets/b.xml"), "xl/worksheets/a.xml": sheet, "xl/worksheets/b.xml": "<worksheet/>", "xl/sharedStrings.xml": "<sst><si><t>x</t></si></sst>"})
    files = spark.createDataFrame([("a.docx", docx), ("b.PPTX", pptx), ("c.xlsx", xlsx), ("d.docx", bytearray(b"no zip")), ("e.txt", bytearray(b"x")), ("f.docx", None)], "path string, content binary")
    rows = documents.office_pages(files).collect()
    assert sorted((r.path, r.page, r.text) for r in rows if r.error is None) == [("a.docx", 1, "one\ttwo"), ("a.docx", 2, "สาม"), ("b.PPTX", 1, "a\nb"), ("b.PPTX", 2, "Slide 2"), ("c.xlsx", 1, "x\t\t2.5\n\tTrue\t"), ("c.xlsx", 2, "Sheet 2")]
    assert sorted(r.path for r in rows if r.error) == ["d.docx", "f.docx"]
    assert documents.office_pages(files.where("false")).count() == 0
    pages = documents.office_pages(files).where("error is null")
    assert documents.chosen_pages(pages.where("path = 'a.docx'"), [2]).count() == 1
    with pytest.raises(Exception, match="no page 3"):
        documents.chosen_pages(pages, [3]).collect()


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/chunk_001.txt").write_text("first\nlines")
    (tmp_path / "in/manifest.json").write_text(json.dumps({"total_chunks": 3, "chunks": [{"chunk_id": 1, "file": "chunk_001.txt"}, {"chunk_id": 2, "file": "chunk_002.txt"}, {"chunk_id": 3, "content": "own"}]}))
    assert {r.chunk_id: r.content for r in documents.manifest_chunks(spark, str(tmp_path / "in")).collect()} == {1: "first\nlines", 2: "", 3: "own"}
    (tmp_path / "t.json").write_text(json.dumps({"source_file": "f", "chunks": [{"chunk_id": 4, "triples": [{"subject": "a", "predicate": "p", "object": "b"}, {"subject": "c"}]}, {"chunk_id": 5, "triples": []}]}))
    assert [(r.chunk_id, r.triple_no, r.subject) for r in documents.triples(spark, str(tmp_path / "t.json")).orderBy("triple_no").collect()] == [(4, 0, "a"), (4, 1, "c")]
    df = spark.createDataFrame([("x", 1, "abc"), ("x", 2, "d"), ("y", 1, "")], "community_id string, chunk_id long, content string")
    assert {r.community_id: r.total_characters for r in reports.write_chunks(df, str(tmp_path / "out")).collect()} == {"x": 4, "y": 0}
    t = df.select("chunk_id", F.col("content").alias("subject"))
    reports.write_triples(t, str(tmp_path / "tr"))
    reports.write_triples(t.where("chunk_id = 2").withColumn("subject", F.lit("new")), str(tmp_path / "tr"))
    assert sorted(r.subject for r in spark.read.parquet(str(tmp_path / "tr")).collect()) == ["", "abc", "new"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.md").write_text("x" * 30)
    got = reports.read_reports(spark, str(tmp_path / "r"), each=10)
    assert got.endswith("x" * 10 + reports.CUT) and [r.size for r in reports.listed(spark, str(tmp_path / "r")).collect()] == [30]


def test_schema(spark):
    s = schema.parse(RULES)
    assert s.enums == {"Balance": ["high", "low"]} and s.relations == [("Supplier", "LOCATED_IN", "Nation")] and len(s.fields) == 3
    nodes = spark.createDataFrame([("Supplier", {"name": "a", "balance": "low"}), ("Supplier", None), (None, {}), ("Supplier", {"name": "a", "balance": None})], "type string, fields map<string, string>")
    assert [r.errors for r in schema.node_errors(nodes, s).collect()] == [[], ["Missing required field: name", "Missing required field: balance"], ["Unknown node type: None"], ["Invalid value for balance: None. Must be one of: high, low"]]
    s.enums |= {"DomainCode": ["d"], "EvidenceStrength": ["weak"], "ScopeLevel": ["v"], "SocialCapitalLevel": ["p"]}
    found = lambda p: spark.createDataFrame([(json.dumps(p),)], "p string").select(schema.payload_errors(F.col("p"), s)).first()[0]
    good = {"tambon": "t", "village": "v", "domain": "d"}
    assert found(good) == []
    assert found({"tambon": "t", "domain": "z"}) == ["Missing required field: village", "Invalid domain: z. Must be one of: d"]
    assert found(good | {"social_capital": {"level": "q"}, "impacts": "no"})[0] == "social_capital must have 'name' and 'level' fields"
    assert found(good | {"impacts": [{"name": "a", "type": "b", "evidence_strength": "weak"}, {"name": "a", "evidence_strength": "x"}]}) == ["impact[1] must have 'name', 'type', and 'evidence_strength' fields", "Invalid impact evidence_strength: x. Must be one of: weak"]
    assert len(found(good | {"activity": {"name": "a", "scope_level": "v"}})) == 4


def test_communities_and_answers(spark):
    old = spark.createDataFrame([(1, "a", [1.0, 0.0])], "id long, name string, vec array<double>")
    new = spark.createDataFrame([(2, "b", [1.0, 0.01]), (3, "c", [0.0, 1.0]), (4, "d", [0.01, 1.0]), (5, "e", [1.0, 1.0])], old.schema)
    assert sorted(r.id for r in communities.insert_new(old, new).collect()) == [1, 3, 5]
    with pytest.raises(Exception, match="mandatory fields"):
        communities.with_unique_id(spark.createDataFrame([("1", " ")], "moo string, village string")).collect()
    row = spark.range(1).select(communities.label([F.lit(" "), F.lit("x"), F.lit("x"), F.lit("y"), F.lit("z")], F.lit("i")), communities.label([F.lit("")], F.lit("i"))).first()
    assert tuple(row) == ("x / y", "i")

    def write(key, text):
        if text is None:
            raise ValueError("empty")
        return f"{key}:{text}"

    texts = spark.createDataFrame([("x", "t"), ("y", None)], "community_id string, text string")
    assert {r.community_id: (r.summary, r.error) for r in answers.summaries(texts, write).collect()} == {"x": ("x:t", None), "y": (None, "empty")}
    t = spark.createDataFrame([(1, "ก", "a", "p", "q", "o", "r"), (2, "ก", "ก", "p", "q", "o", "r"), (3, None, None, "p", "q", "o", "r")], "chunk_id long, subject string, subject_en string, predicate string, predicate_en string, object string, object_en string")
    assert {r.chunk_id: r.complete for r in triples.translated_chunks(t, ["chunk_id"]).collect()} == {1: True, 2: False, 3: True}


def test_stream(spark, tmp_path):
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, edge_type string, dst string, chunk_id long").coalesce(1)
    come, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = edges(("a", "E", "b", 2), ("a", "E", "b", 1))
    one.write.mode("append").parquet(come)
    ingest.append_first_edges(ingest.arriving(spark, come, one.schema), out, state).awaitTermination()
    edges(("a", "E", "b", 0), ("b", "E", "c", 5)).write.mode("append").parquet(come)
    ingest.append_first_edges(ingest.arriving(spark, come, one.schema), out, state).awaitTermination()
    assert sorted((r.src, r.dst, r.chunk_id) for r in spark.read.parquet(out).collect()) == [("a", "b", 1), ("b", "c", 5)]


def test_window_counts(spark, tmp_path):
    at = lambda h, kind, v: (f"2024-01-01 {h:02d}:30:00", kind, v)
    df = spark.createDataFrame([at(1, "a", 1.0), at(1, "a", 2.0), at(2, "b", None), at(9, "a", 4.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.counts_by_window(ingest.arriving(spark, str(tmp_path / "in"), df.schema))
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("counted").select(F.hour("start").alias("h"), "event_type", "n", "total").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 2, 3.0), (2, "b", 1, None), (9, "a", 1, 4.0)]
