"""Contexts and their sections, running budgets, sentences, and reports read back, against loops over the same rows."""

import json
import random
import re

from pyspark.sql import functions as F

from weftgraph.context_queries import lines_of_context
from weftgraph.operators import context
from weftgraph.sources import reports

SF = "/root/testdata/sf0.001"


def _whole(text):
    """Sections of a text whose marks are whole lines, line by line: a mark without an end opens nothing."""
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        m = re.fullmatch(r"<!-- COMMUNITY_START: (.*) -->", lines[at])
        end = m and next((k for k in range(at + 1, len(lines)) if lines[k] == f"<!-- COMMUNITY_END: {m[1]} -->"), None)
        if end is not None and m:
            out.append((m[1], at, "\n".join(lines[at + 1 : end]).strip()))
            at = end
        at += 1
    return out


def _lines(spark, files):
    rows = [(f, k, x) for f, t in files.items() for k, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def test_sections_of_odd_files(spark):
    rng = random.Random(5)
    part = [f"<!-- COMMUNITY_{k}: {c} -->" for k in ("START", "START", "END", "END") for c in ("a", "b b", "")] + ["# a", "", " x ", "text <!-- COMMUNITY_START: a -->", "<!-- COMMUNITY_END: a --> ", "ก"]
    files = {f"f{k}": "\n".join(rng.choice(part) for _ in range(rng.randint(1, 40))) for k in range(60)}
    files["long"] = "\n".join(["<!-- COMMUNITY_START: a -->"] + [f"line {k}" for k in range(1500)] + ["<!-- COMMUNITY_END: a -->", "<!-- COMMUNITY_START: a -->", "again", "<!-- COMMUNITY_END: a -->"])
    files["none"] = "no marks\nat all"
    found = {}
    for r in context.section_texts(context.sections(_lines(spark, files))).collect():
        found.setdefault(r.file, []).append((r.community_id, r.first, r.text))
    # A section without any line between its marks has no row.
    want = {f: [x for x in _whole(t) if t.split("\n")[x[1] + 1] != f"<!-- COMMUNITY_END: {x[0]} -->"] for f, t in files.items()}
    assert {f: sorted(x, key=lambda s: s[1]) for f, x in found.items()} == {f: x for f, x in want.items() if x}
    assert len(found["long"]) == 2 and sum(map(len, want.values())) > 60
    assert context.sections(_lines(spark, {"a": "x"}).limit(0)).count() == 0


def test_context_comes_back_in_sections(spark):
    rows = sorted(lines_of_context(spark, SF).collect())
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
    text = "\n".join(r.line for r in rows)
    pattern = re.compile(r"<!-- COMMUNITY_START: (.*?) -->\n(.*?)<!-- COMMUNITY_END: \1 -->", re.DOTALL)
    want = sorted((m[1], m[2].strip()) for m in pattern.finditer(text))
    got = context.section_texts(context.sections(_lines(spark, {"f": text})))
    assert sorted((r.community_id, r.text) for r in got.collect()) == want and len(want) > 10


def test_budget_against_a_loop(spark):
    rng = random.Random(3)
    texts = {"hot": [rng.choice(["x" * rng.randint(1, 9), "ก" * 4, "", None]) for _ in range(3000)], "exact": ["x" * 20, "y" * 30, "z"], "one": ["w" * 51], "few": ["a", None, "b"], "none": [None, ""]}
    rows = [(g, k, t) for g, ts in texts.items() for k, t in enumerate(ts)]
    rng.shuffle(rows)
    kept, omitted = context.budgeted(spark.createDataFrame(rows, "g string, k int, text string").repartition(7), "g", ["k"], 50)
    want, left = [], {}
    for g, ts in texts.items():
        used, place = 0, 0
        for k, t in enumerate(ts):
            if not t:
                continue
            if used >= 50:
                left[g] = left.get(g, 0) + 1
                continue
            place += 1
            want.append((g, k, place, t if len(t) <= 50 - used else t[: 50 - used] + context.CUT))
            used += len(t)
    assert sorted(map(tuple, kept.select("g", "k", "place", "text").collect())) == sorted(want)
    assert {r.g: r.n_omitted for r in omitted.collect()} == left and left["exact"] == 1 and left["hot"] > 1000


def test_context_of_odd_results(spark):
    results = spark.createDataFrame([("a", "r1", 2.0, "A"), ("a", "r2", 2.0, None), ("b", "r1", 3.0, "A"), ("b", "r3", 1.0, "C")], "community_id string, result_id string, score double, line string")
    links = spark.createDataFrame([("r1", "n -> (linked) -> A"), ("r3", "n -> (linked) -> A")], "result_id string, line string")
    texts = spark.createDataFrame([("a", 1, "one\ntwo"), ("c", 1, "nobody's"), ("b", 1, None)], "community_id string, k int, text string")
    labels = spark.createDataFrame([("a", "Village A"), ("b", None)], "community_id string, label string")
    got = [r.line for r in context.context_lines(results, links, texts, ["k"], labels, cap=1).orderBy("line_no").collect()]
    link, head, rest = ["", "n -> (linked) -> A"], ["## relationships", ""], ["", "## relevant content (references for relationships)", ""]
    b = ["<!-- COMMUNITY_START: b -->", "# b", "", *head, "A", *link, *rest, *context.NO_TEXT.split("\n"), "<!-- COMMUNITY_END: b -->", ""]
    a = ["<!-- COMMUNITY_START: a -->", "# Village A (internal id: a)", "", *head, "A", *link, *rest, "one", "two", "", "<!-- COMMUNITY_END: a -->", ""]
    assert got == b + a
    assert context.context_lines(results.limit(0), links, texts, ["k"]).count() == 0


def test_reports_read_back(spark, tmp_path):
    values = [{"a": 1, "t": "### Result 7\n```json\n{}\n```"}, {"a": None, "ก": [1, {"b": "```"}]}, {}]
    good = "# Query Results: x\n\n" + "\n".join(f"### Result {k}\n\n```json\n{json.dumps(v, indent=2, ensure_ascii=False)}\n```\n" for k, v in enumerate(values, 1))
    bad = "### Result 1\n```json\n{broken\n```\n\n### Result 2 \n```json \n[1, 2]\n```\n### Result x\n```json\n{}\n```\n### Result 4\nno block\n"
    for name, text in (("good.md", good), ("bad.md", bad), ("none.md", "# Query Results: y\n\n*No results found*\n"), ("other.txt", good)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted((r.path.rpartition("/")[2], r.result_no, json.loads(r.json)) for r in reports.results_in(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [("bad.md", 2), ("good.md", 1), ("good.md", 2), ("good.md", 3)]
    assert [g[2] for g in got] == [[1, 2], *values]
    rows = spark.range(1, 40).select(F.col("id").alias("pos"), F.concat(F.lit('q"\n### Result '), "id").alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    reports.report(rows, "t", "q").select("line").write.text(f"{tmp_path}/written")
    back = {r.result_no: json.loads(r.json) for r in reports.results_in(spark, f"{tmp_path}/written", "*.txt").collect()}
    assert back == {k: {"v": f'q"\n### Result {k}'} | ({"n": k} if k % 2 == 0 else {}) for k in range(1, 40)}


def test_sentences_of_odd_values(spark):
    node = "struct<name:string,type:string>"
    row = spark.createDataFrame([((None, None), ("B", ""), {"z": "1", "a": None, "b": "2"}, [("A", "T"), ("B", None)], ["p"])], f"s {node}, o {node}, m map<string,string>, chain array<{node}>, ps array<string>")
    c, no = F.col, F.lit(None).cast("string")
    names = F.array().cast("array<string>")
    got = row.select(
        context.triple_sentence(c("s"), no, c("o"), no, F.lit(0), c("m")), context.triple_sentence(c("o"), F.lit("p"), c("o"), F.lit("x"), F.lit(3), F.create_map().cast("map<string,string>")),
        context.path_sentence(c("chain"), c("ps"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit(""), context.edge_note(F.lit("p"), c("m")))), context.path_sentence(F.filter("chain", lambda x: F.lit(False)), names, names, names),
        context.evidence_sentence(F.lit("q"), F.lit("e"), F.lit("t" * 601), F.array(F.lit("A"), F.lit("B")), names, no, F.lit("")), context.evidence_sentence(F.lit("q"), F.lit("q"), F.lit("q"), names, names, F.lit("x"), F.lit(0)),
        context.evidence_sentence(no, no, no, names, names, no, no), context.value_sentence(c("m")), context.value_sentence(F.create_map(F.lit("a"), F.lit(""))),
    ).first()
    assert list(got) == [
        "[?] --(?)--> [B]\n  b: 2  z: 1", "[B] --(p)--> [B]\n  community: x  chunk: 3",
        "PATH: [A] (T) --(p)--> [B]\n  communities: x, y\n  [p] b: 2, z: 1", "[empty path]",
        f'EVIDENCE (EN): "e"\nEVIDENCE (original): "q"\nSOURCE TEXT: "{"t" * 600}…"\n  entities: A, B', 'EVIDENCE (EN): "q"\n  community: x',
        "[empty evidence]", "b: 2\nz: 1", "[empty result]",
    ]
