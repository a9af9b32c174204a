"""Registered queries of answer parsing, chunking, translation, planning, answers and diagnostics, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import model_output, text
from weftgraph.operators import answers, chunking, diagnostics, graph, triples
from weftgraph.plans import planner, views
from weftgraph.plans.views import table
from weftgraph.queries import KG, query

def _id() -> Column:
    return F.col("event_id")


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("j04_triple_answers", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 5 IN (1, 2, 3) THEN 'it''s ' || event_id END AS subject,
CASE event_id % 5 WHEN 1 THEN '1' WHEN 2 THEN '7' END AS start, CASE event_id % 5 WHEN 1 THEN '4' WHEN 2 THEN '7' END AS "end" FROM events""")
def j04(spark, d):
    triple = lambda a, z: _text('{"discovered_triples": [{"subject": "it\'s ', _id(), f'", "predicate": "p", "object": "o", "evidence_lines": {{"start": {a}, "end": {z}}} }},]}}')
    answer = F.when(_id() % 5 == 0, "{ _PROCESSING_ }").when(_id() % 5 == 1, _text("Here:\n```json\n", triple("-2", "4"), "\n```")).when(_id() % 5 == 2, triple("7", "3")).when(_id() % 5 == 3, triple('"x"', "3")).otherwise('{"other": []}')
    found = model_output.triple_answer(answer)
    first = lambda c: F.get(F.col("t"), F.lit(0))[c]
    return events(spark, d).withColumn("t", found).select("event_id", F.size("t").alias("n"), first("subject").alias("subject"), first("start").cast("string").alias("start"), first("end").cast("string").alias("end"))


@query("j07_ranges_by_pattern", 'SELECT event_id, 1 AS k, 3::BIGINT AS start, event_id + 4 AS "end" FROM events UNION ALL SELECT event_id, 2, event_id, event_id * 2 FROM events WHERE event_id % 2 = 0')
def j07(spark, d):
    answer = F.concat(_text('chunks: {"start": 3, "end" : ', _id() + 4, "} ,"), F.when(_id() % 2 == 0, _text('{"id": 2, "start":', _id(), ', "end":', _id() * 2)).otherwise('{"start": 5'))
    return events(spark, d).select("event_id", F.posexplode(model_output.ranges_by_pattern(answer)).alias("k", "r")).select("event_id", (F.col("k") + 1).alias("k"), "r.start", "r.end")


@query("j08_split_points", 'SELECT event_id, 1 AS id, 1::BIGINT AS start, 4::BIGINT AS "end" FROM events UNION ALL SELECT event_id, 2, 5, 9 + event_id % 7 FROM events UNION ALL SELECT event_id, 3, 10 + event_id % 7, 20 FROM events')
def j08(spark, d):
    points = model_output.numbers_in_list(_text('{"split_at": [ 5, ', _id() % 7 + 10, ", 5, 90 ]}"))
    return events(spark, d).select("event_id", F.explode(model_output.split_ranges(points, F.lit(20).cast("long"))).alias("r")).select("event_id", F.col("r.id").cast("int").alias("id"), "r.start", "r.end")


@query("j09_decisions", "SELECT event_id, 1::BIGINT AS id, event_id % 2 = 0 AS same, 'B' AS canon, CASE WHEN event_id % 2 = 0 THEN 'replace' ELSE 'new' END AS outcome FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, 2, true, 'A', 'alias' FROM events WHERE event_id % 4 < 3")
def j09(spark, d):
    items = _text('[{"id": 1, "same": ', F.when(_id() % 2 == 0, "true").otherwise("false"), ', "canon": "B"}, {"id": 2, "same": true, "canon": "A"}]')
    answer = F.when(_id() % 4 == 0, items).when(_id() % 4 == 1, _text("```json\n", items, "\n```")).when(_id() % 4 == 2, _text('{"decisions": ', items, "}")).otherwise("none")
    rows = events(spark, d).select("event_id", F.explode(model_output.listed_decisions(answer)).alias("x")).select("event_id", "x.id", "x.same", "x.canon")
    return rows.withColumn("outcome", model_output.resolution(F.col("same"), F.col("canon")))


@query("j10_translations", "SELECT event_id, 1::BIGINT AS id, CASE event_id % 3 WHEN 0 THEN 'OPEN_' || event_id ELSE 'word ' || event_id END AS value_en FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, 2, 'b' FROM events WHERE event_id % 4 = 1")
def j10(spark, d):
    value = F.when(_id() % 3 == 0, _text("OPEN_", _id())).otherwise(_text('"word ', _id(), '"'))
    one = F.concat(F.lit('{"id": 1, "value_en": '), value, F.lit("}"))
    answer = F.when(_id() % 4 == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(_id() % 4 == 1, F.concat(F.lit("["), one, F.lit(', {"id": 2, "value_en": "b"}]'))).when(_id() % 4 == 2, F.concat(F.lit("So: "), one)).otherwise("nothing")
    return events(spark, d).select("event_id", F.explode(model_output.translations(answer)).alias("x")).select("event_id", "x.id", "x.value_en")


@query("j11_first_object", """SELECT event_id, '{"a": {"b": "}' || event_id || '"}}' AS found FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def j11(spark, d):
    answer = F.when(_id() % 2 == 0, _text('I say {"a": {"b": "}', _id(), '"}} and {"c": 1}')).otherwise(_text("open { ", _id()))
    return events(spark, d).select("event_id", model_output.first_object(answer).alias("found"))


@query("d04_tokens", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, trim(translate(text, chr(10) || chr(13) || chr(9), '   '), ' ') AS clean, regexp_replace(text, '[^\\p{L}\\p{N}]', '_', 'g') AS safe FROM documents")
def d04(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.token_estimate(x).cast("long").alias("tokens"), text.sanitize(x).alias("clean"), text.safe_name(x).alias("safe"))


@query("d05_section_sizes", ", n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CASE WHEN least(n, 1000) <= 100 THEN 100 ELSE least(least(n, 1000) + 50, n) END::INTEGER AS size FROM n")
def d05(spark, d):
    return chunking.section_sizes(table(spark, d, "documents"))


@query("d06_absolute_ranges", ', n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), s AS (SELECT doc_id, n, unnest(generate_series(1, n, 30)) AS section_start FROM n) SELECT doc_id, section_start, section_start AS start, least(n, section_start + 39) AS "end" FROM s')
def d06(spark, d):
    s = chunking.sections(table(spark, d, "documents"), 40, 10).withColumn("section_start", F.col("start").cast("long"))
    rows = s.select("doc_id", "section_start", F.lit(1).cast("long").alias("start"), (F.col("end") - F.col("start") + 1).cast("long").alias("end"))
    return chunking.absolute_ranges(rows)


@query("d07_merged_ranges", ', l AS (SELECT doc_id, line_no + 1 AS start FROM lines), k AS (SELECT doc_id, start, max(start) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, start::BIGINT AS start, least(start + 3, n)::BIGINT AS "end" FROM k WHERE (start - 1) % 4 = 0')
def d07(spark, d):
    n = F.size(F.split("text", "\n"))
    two = F.transform(F.sequence(F.lit(1), n, F.lit(2)), lambda s: F.struct(s.cast("long").alias("start"), F.least(s + 1, n).cast("long").alias("end")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(model_output.merged_small(two)).alias("r")).select("doc_id", "r.start", "r.end")


@query("d11_continued_ids", "SELECT doc_id, community_id, line_no, (10 * (community_id % 3) + row_number() OVER (PARTITION BY community_id ORDER BY doc_id * 100000 + line_no))::BIGINT AS chunk_id FROM (SELECT *, doc_id % 7 AS community_id FROM lines)")
def d11(spark, d):
    new = views.doc_lines(spark, d).select("doc_id", (F.col("doc_id") % 7).alias("community_id"), "line_no", (F.col("doc_id") * 100000 + F.col("line_no")).alias("chunk_id"))
    old = spark.range(7).where("id % 3 <> 0").select(F.col("id").alias("community_id"), F.explode(F.sequence(F.lit(1).cast("long"), 10 * (F.col("id") % 3))).alias("chunk_id"))
    return chunking.continue_ids(new, old)


@query("d12_bands", "SELECT event_id, CASE WHEN event_id % 100 < 30 THEN 'very fine' WHEN event_id % 100 < 50 THEN 'fine' WHEN event_id % 100 < 70 THEN 'medium' ELSE 'coarse' END AS band, CASE WHEN event_id % 101 > 70 THEN 'high' WHEN event_id % 101 > 40 THEN 'medium' ELSE 'low' END AS relevance FROM events")
def d12(spark, d):
    return events(spark, d).select("event_id", text.granularity_band(_id() % 100 / 100).alias("band"), text.relevance_band(_id() % 101).alias("relevance"))


def _tens(numbered: str) -> list[tuple[int, int]]:
    """Stands for a model: ten lines a chunk, and a failure for every third number of lines."""
    n = numbered.count("\n") + 1
    if n % 3 == 0:
        raise ValueError(n)
    return [(a, a + 9) for a in range(1, n + 1, 10)]


@query("d13_chunked", r""", x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, '\S')), f AS (SELECT doc_id, l, unnest(generate_series(1, len(l), 10)) AS a FROM x WHERE len(l) % 3 <> 0),
r AS (SELECT doc_id, (a // 10 + 1)::INTEGER AS chunk_id, regexp_replace(array_to_string(l[a:a + 9], chr(10)), '^\s+|\s+$', '', 'g') AS content, a::BIGINT AS start_line, least(a + 9, len(l))::BIGINT AS end_line FROM f)
SELECT * FROM r WHERE content <> '' UNION ALL SELECT doc_id, 1, regexp_replace(array_to_string(l, chr(10)), '^\s+|\s+$', '', 'g'), 1, len(l) FROM x WHERE len(l) % 3 = 0""")
def d13(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    return chunking.chunked(docs.select("doc_id", "text"), _tens)


def _english(values: list[str]) -> list[str | None]:
    """Stands for a model: words of four letters come back as they are, of five letters blank."""
    return [v if len(v) == 4 else " " if len(v) == 5 else f"EN {v}" for v in values]


EN = "CASE WHEN length({0}) IN (4, 5) THEN NULL ELSE 'EN ' || {0} END"


@query("x07_translated", ", v AS (SELECT 'subject' AS role, subject AS value FROM raw UNION SELECT 'object', object FROM raw) SELECT role, value, " + EN.format("value") + " AS value_en FROM v")
def x07(spark, d):
    words = views.raw_triples(spark, d).unpivot(["doc_id"], ["subject", "object"], "role", "value").select("role", "value").distinct()
    return triples.translated(words, _english)


X09 = f", z AS (SELECT doc_id, chunk_id FROM raw GROUP BY ALL HAVING bool_or(length(subject) = 6)), y AS (SELECT raw.*, z.doc_id IS NOT NULL AS q FROM raw LEFT JOIN z USING (doc_id, chunk_id)), e AS (SELECT doc_id, chunk_id, triple_no, subject, predicate, object, CASE WHEN q THEN {EN.format('subject')} END AS subject_en, CASE WHEN q THEN {EN.format('object')} END AS object_en FROM y)"


def _translated(spark, d) -> DataFrame:
    t = views.raw_triples(spark, d).drop("evidence_quote")
    return triples.translate_chunks(t, _english, ["doc_id", "chunk_id"], ("subject", "object"), F.length("subject") == 6)


@query("x09_translated_chunks", X09 + " SELECT * FROM e")
def x09(spark, d):
    return _translated(spark, d)


@query("x02_complete_chunks", X09 + " SELECT doc_id, chunk_id, bool_and(subject_en IS NOT NULL AND object_en IS NOT NULL) AS complete FROM e GROUP BY ALL")
def x02(spark, d):
    return triples.translated_chunks(_translated(spark, d), ["doc_id", "chunk_id"], ("subject", "object"))


@query("x04_without_english", "SELECT doc_id, triple_no, subject, NULL::VARCHAR AS subject_en FROM raw")
def x04(spark, d):
    t = views.raw_triples(spark, d).select("doc_id", "triple_no", "subject", F.upper("subject").alias("subject_en"))
    return triples.without_english(t)


@query("t04_stamped", "SELECT doc_id, triple_no, subject, 'k' || doc_id % 3 AS community_id, chunk_id::VARCHAR AS chunk_id FROM raw")
def t04(spark, d):
    t = views.raw_triples(spark, d).select("doc_id", "triple_no", "subject", F.col("chunk_id").alias("own"))
    return triples.stamped(t, F.concat(F.lit("k"), F.col("doc_id") % 3), F.col("own")).drop("own")


@query("v10_languages", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Thai' ELSE 'English' END AS language, doc_id % 3 = 0 AS digits FROM documents")
def v10(spark, d):
    i = F.col("doc_id")
    x = F.concat(F.when(i % 2 == 0, "หมู่บ้าน ").otherwise("village "), F.when(i % 3 == 0, "7").otherwise("x"))
    return table(spark, d, "documents").select("doc_id", text.script_language(x).alias("language"), text.has_digit(x).alias("digits"))


@query("s20_chunk_refs", KG + "SELECT DISTINCT community_id, chunk_id FROM kg_rows")
def s20(spark, d):
    return planner.chunk_refs(views.kg_edge_rows(spark, d))


@query("n01_free_query", "SELECT type, count(*) AS n FROM nodes WHERE name <> 'NATION_3' GROUP BY type")
def n01(spark, d):
    return planner.run_sql(spark, "SELECT type, count(*) AS n FROM kg_nodes WHERE name <> :name GROUP BY type", {"kg_nodes": views.kg_nodes(spark, d)}, name="NATION_3")


@query("n12_relation_types", "SELECT edge_type, count(*) AS n FROM (SELECT edge_type FROM ordered UNION ALL SELECT edge_type FROM geo UNION ALL SELECT 'SUPPLIES' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1")
def n12(spark, d):
    return views.kg_edge_rows(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("n13_compared_stores", """, a AS (SELECT canonical_id, CASE WHEN type = 'Nation' THEN lower(name) ELSE name END AS name, type FROM nodes WHERE type <> 'Region'), b AS (SELECT * FROM nodes WHERE type <> 'Supplier'),
l AS (UNPIVOT a ON name, type INTO NAME "column" VALUE left_value), r AS (UNPIVOT b ON name, type INTO NAME "column" VALUE right_value)
SELECT canonical_id, "column", left_value, right_value, CASE WHEN right_value IS NULL THEN 'left only' WHEN left_value IS NULL THEN 'right only' WHEN left_value = right_value THEN 'same' ELSE 'differs' END AS status FROM l FULL JOIN r USING (canonical_id, "column")""")
def n13(spark, d):
    n = views.kg_nodes(spark, d)
    registry = n.where("type <> 'Region'").withColumn("name", F.when(F.col("type") == "Nation", F.lower("name")).otherwise(F.col("name")))
    return diagnostics.compared(registry, n.where("type <> 'Supplier'"), "canonical_id", ["name", "type"])


@query("h05_sentence_coverage", r""", s AS (SELECT doc_id, line_no, lower(trim(text, ' ')) AS s FROM lines WHERE trim(text, ' ') <> ''), q AS (SELECT DISTINCT doc_id, lower(evidence_quote) AS q FROM raw WHERE triple_no % 3 = 0),
sw AS (SELECT *, regexp_split_to_array(s, '\s+') AS w FROM s), qw AS (SELECT doc_id, q, regexp_split_to_array(trim(q, ' '), '\s+') AS w FROM q),
sg AS (SELECT doc_id, line_no, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM sw WHERE len(w) > 3)),
qg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM qw)),
h AS (SELECT doc_id, line_no FROM sg JOIN qg USING (doc_id, g) UNION SELECT doc_id, line_no FROM sw JOIN q USING (doc_id) WHERE len(sw.w) <= 3 AND contains(q.q, sw.s))
SELECT s.doc_id, count(*) AS n_sentences, count(h.line_no) AS n_covered, round(count(h.line_no) * 100.0::DOUBLE / count(*), 9) AS percent FROM s LEFT JOIN h USING (doc_id, line_no) GROUP BY 1""")
def h05(spark, d):
    out = diagnostics.sentence_coverage(views.doc_lines(spark, d), views.raw_triples(spark, d).where("triple_no % 3 = 0"))
    return out.withColumn("percent", F.round("percent", 9))


def community_ids(spark, d) -> DataFrame:
    """Suppliers and market segments by nation, for nations with an even key; empty lists for the others."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("p"))
    s = table(spark, d, "supplier").where("s_nationkey % 2 = 0").groupBy("s_nationkey").agg(F.array_sort(F.collect_set("s_suppkey")).alias("e"))
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    some = F.when(F.col("n_nationkey") % 2 == 0, F.col("p"))
    return n.select(F.col("n_name").alias("community"), F.coalesce(F.col("e").cast("array<string>"), F.array().cast("array<string>")).alias("entities"), F.coalesce(some, F.array().cast("array<string>")).alias("predicates"))


SPECS = """, n AS (SELECT n_nationkey AS k, n_name AS community, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND n_nationkey % 2 = 0) AS e, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND n_nationkey % 2 = 0) AS p FROM nation),
t AS (SELECT *, unnest(CASE WHEN e = 0 AND p = 0 THEN ['community_explore'] WHEN e >= 2 THEN ['graph_hop', 'find_paths'] ELSE ['graph_hop'] END) AS tool FROM n),
sp AS (SELECT community, k, tool, e::INTEGER AS n_entities, CASE tool WHEN 'graph_hop' THEN 1 WHEN 'find_paths' THEN 3 END AS depth, CASE tool WHEN 'graph_hop' THEN 50 WHEN 'find_paths' THEN 20 ELSE 100 END AS lim FROM t)"""


@query("l02_community_specs", SPECS + ' SELECT community, tool, n_entities, coalesce(depth, 0) AS depth, lim AS "limit" FROM sp')
def l02(spark, d):
    return planner.community_specs(community_ids(spark, d)).select("community", "tool", F.size("entities").alias("n_entities"), F.coalesce("depth", F.lit(0)).alias("depth"), "limit")


@query("l03_tuned_specs", SPECS + """ SELECT community, tool, CASE WHEN tool = 'graph_hop' AND k % 4 = 0 THEN 2 ELSE coalesce(depth, 0) END AS depth, CASE WHEN tool = 'graph_hop' AND k % 4 = 0 THEN 10 + k ELSE lim END AS "limit" FROM sp""")
def l03(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("community"), F.col("n_nationkey").alias("k"))
    tools = F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(p).alias("pos")) for t, p in (("graph_hop", 1), ("graph_hop", 2), ("no_tool", 0)))))
    tuned = n.select("community", "k", tools.alias("t")).select("community", "t.tool", "t.pos", (F.col("t.pos") + 1).alias("depth"), (10 * F.col("t.pos") + F.col("k")).alias("limit"))
    return planner.tuned_specs(planner.community_specs(community_ids(spark, d)), tuned).select("community", "tool", F.coalesce("depth", F.lit(0)).alias("depth"), "limit")


@query("l07_label_group_seeds", """, l AS (SELECT DISTINCT p_brand AS label, CASE WHEN p_size % 2 = 0 THEN 'g0' ELSE 'g1' END AS grp FROM part), o AS (SELECT DISTINCT label FROM l WHERE grp = 'g0' ORDER BY label LIMIT 5)
SELECT id, label FROM (SELECT 'p:' || p_partkey AS id, p_brand AS label, row_number() OVER (PARTITION BY p_brand ORDER BY 'p:' || p_partkey) AS rn FROM part WHERE p_brand IN (FROM o)) WHERE rn <= 50""")
def l07(spark, d):
    p = table(spark, d, "part")
    labels = p.select(F.col("p_brand").alias("label"), F.when(F.col("p_size") % 2 == 0, "g0").otherwise("g1").alias("grp")).distinct()
    return planner.label_group_seeds(labels, p.select(views.key("p:", "p_partkey").alias("id"), F.col("p_brand").alias("label")), ["g0"])


@query("l09_seeds_from_results", KG + "SELECT src AS id FROM kg_rows UNION SELECT dst FROM kg_rows")
def l09(spark, d):
    return planner.seeds_from_results(views.kg_edge_rows(spark, d))


@query("l08_connectivity_seeds", KG + """, e AS (SELECT DISTINCT src, edge_type, dst FROM kg), g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY 1)
SELECT id FROM (SELECT canonical_id AS id, coalesce(n, 0) AS n FROM nodes LEFT JOIN g ON g.id = canonical_id) ORDER BY n DESC, id LIMIT 20""")
def l08(spark, d):
    return graph.top_degree(views.kg_nodes(spark, d), views.kg_links(spark, d)).select(F.col("canonical_id").alias("id"))


@query("y01_no_results", f"SELECT doc_id AS question_id, '{answers.NOTHING}' AS answer FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM raw)")
def y01(spark, d):
    return answers.no_results(table(spark, d, "documents").select(F.col("doc_id").alias("question_id")), views.raw_triples(spark, d).select(F.col("doc_id").alias("question_id")))


@query("y02_combined", """, s AS (SELECT doc_id AS question_id, chunk_id AS pos, 'chunk ' || chunk_id || ' of ' || count(*) AS summary FROM raw GROUP BY 1, 2), j AS (SELECT question_id, count(*) AS n, string_agg(summary, chr(10) || chr(10) ORDER BY pos, summary) AS a FROM s GROUP BY 1)
SELECT question_id, CASE WHEN n >= 3 THEN 'In all: ' || a ELSE a END AS answer FROM j""")
def y02(spark, d):
    g = views.raw_triples(spark, d).groupBy(F.col("doc_id").alias("question_id"), F.col("chunk_id").alias("pos")).agg(F.count("*").alias("n"))
    return answers.combined(g.select("question_id", "pos", _text("chunk ", F.col("pos"), " of ", F.col("n")).alias("summary")), lambda x: "In all: " + x)


@query("y03_line_counts", ", r AS (SELECT doc_id, count(*) AS n FROM raw WHERE subject <> object GROUP BY 1) SELECT doc_id, n::INTEGER AS n_results FROM r")
def y03(spark, d):
    line = F.when(F.col("subject") == F.col("object"), _text(F.col("subject"), " -> (linked) -> x")).otherwise(_text(F.col("subject"), " -> (p) -> ", F.col("object"), "\n"))
    t = views.raw_triples(spark, d).groupBy("doc_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"), F.max((F.col("subject") != F.col("object")).cast("int")).alias("some"))
    return answers.line_counts(t.where("some = 1"), "doc_id")
