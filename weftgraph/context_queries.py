"""Registered queries of contexts, their sections, sentences of results and reports read back, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import context, results
from weftgraph.plans import views
from weftgraph.plans.materialize import materialize, shared_dir
from weftgraph.plans.views import table
from weftgraph.queries import query
from weftgraph.registry_queries import PATHS, PROPS, place_paths, slim, with_properties
from weftgraph.sources import reports

#: The lines of the context of all communities: nations, their 50 best triples, and the chunks of the documents.
CONTEXT = PROPS + r"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY score DESC, pos) AS rank FROM (SELECT community_id, (chunk_id % 11)::DOUBLE AS score, src || '|' || edge_type || '|' || dst AS pos, src, dst, sn, onm, sn || ' -> (' || edge_type || ') -> ' || onm || ' | weight: ' || weight AS line FROM tr)),
gr AS (SELECT community_id, row_number() OVER (ORDER BY -score, pos, community_id) AS g FROM rk WHERE rank = 1),
lk AS (SELECT community_id, l, min(rank) AS rank FROM (SELECT community_id, rank, unnest(list_filter([CASE WHEN lower(sn) <> sn THEN lower(sn) || ' -> (linked) -> ' || sn END, CASE WHEN lower(onm) <> onm THEN lower(onm) || ' -> (linked) -> ' || onm END], lambda x: x IS NOT NULL)) AS l FROM rk WHERE rank <= 50) GROUP BY ALL),
bt AS (SELECT n_name AS community_id, content, row_number() OVER w AS place, count(*) OVER (PARTITION BY n_name) AS n, coalesce(sum(length(content)) OVER (PARTITION BY n_name ORDER BY doc_id, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM chunks JOIN nation ON doc_id % 25 = n_nationkey WINDOW w AS (PARTITION BY n_name ORDER BY doc_id, chunk_id)),
el AS (SELECT g, 0 AS s, 0 AS k, '' AS t, '<!-- COMMUNITY_START: ' || community_id || ' -->' AS line, community_id FROM gr
  UNION ALL SELECT g, 1, 0, '', '# the ' || community_id || ' (internal id: ' || community_id || ')' || chr(10), community_id FROM gr
  UNION ALL SELECT g, 2, 0, '', '## relationships' || chr(10), community_id FROM gr
  UNION ALL SELECT g, 3, rank, '', line, community_id FROM rk JOIN gr USING (community_id) WHERE rank <= 50
  UNION ALL SELECT g, 4, 0, '', '', community_id FROM gr
  UNION ALL SELECT g, 5, rank, l, l, community_id FROM lk JOIN gr USING (community_id)
  UNION ALL SELECT g, 6, 0, '', '', community_id FROM gr
  UNION ALL SELECT g, 7, 0, '', '## relevant content (references for relationships)' || chr(10), community_id FROM gr
  UNION ALL SELECT g, 8, place, '', CASE WHEN used + length(content) > 8000 THEN substr(content, 1, (8000 - used)::INTEGER) || chr(10) || chr(10) || '[truncated — community content cap reached]' ELSE content END || chr(10), community_id FROM bt JOIN gr USING (community_id) WHERE used < 8000
  UNION ALL SELECT g, 8, 0, '', '*No reference chunk text available for this community*' || chr(10), community_id FROM gr WHERE community_id NOT IN (SELECT community_id FROM bt)
  UNION ALL SELECT g, 9, 0, '', '*[' || n || ' more chunk(s) omitted — community content cap reached]*', community_id FROM (SELECT community_id, count(*) AS n FROM bt WHERE used >= 8000 GROUP BY ALL) JOIN gr USING (community_id)
  UNION ALL SELECT g, 10, 0, '', '<!-- COMMUNITY_END: ' || community_id || ' -->' || chr(10), community_id FROM gr),
cl AS (SELECT row_number() OVER (ORDER BY g, s, k, t, i) AS line_no, community_id, s, line FROM (SELECT g, s, k, t, community_id, unnest(string_split(line, chr(10))) AS line, generate_subscripts(string_split(line, chr(10)), 1) AS i FROM el))"""


def lines_of_context(spark, d) -> DataFrame:
    nodes, cap = views.kg_nodes(spark, d), 50
    edges = views.kg_edges(spark, d).withColumns({"result_id": F.concat_ws("|", "src", "edge_type", "dst"), "score": (F.col("chunk_id") % 11).cast("double")})
    shown = materialize(results.best_known(edges, nodes, "community_id", "result_id", cap).drop("rank"), "shown")  # a context shows no others, so no others are named
    triples = results.slim_triples(with_properties(shown), nodes).withColumn("result_id", F.concat_ws("|", "subject.canonical_id", "predicate", "object.canonical_id"))
    triples = materialize(triples, "triples")
    line = results.path_line(F.array("subject", "object"), F.array("predicate"), F.col("properties"))
    rows = triples.select("community_id", "result_id", (F.col("chunk_id") % 11).cast("double").alias("score"), line.alias("line"))
    uses = triples.select("result_id", F.explode(F.array("subject.canonical_id", "object.canonical_id")).alias("canonical_id"), F.lit(None).cast("string").alias("predicate"))
    details = nodes.select(F.lit("entity").alias("kind"), "canonical_id", "name", F.lit("").alias("name_en"), F.array(F.lower("name")).alias("raw_names"))
    nation = table(spark, d, "nation")
    chunks = views.doc_chunks(spark, d).join(F.broadcast(nation), F.col("doc_id") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("community_id"), "doc_id", "chunk_id", F.col("content").alias("text"))
    labels = nation.select(F.col("n_name").alias("community_id"), F.concat(F.lit("the "), "n_name").alias("label"))
    return context.context_lines(rows, results.link_lines(uses, details), chunks, ["doc_id", "chunk_id"], labels, cap)


@query("a13_context_lines", CONTEXT + " SELECT line_no, line FROM cl")
def a13_lines(spark, d):
    return lines_of_context(spark, d)


@query("a14_sections", CONTEXT + " SELECT 'all' AS file, community_id, first, line_no, line FROM (SELECT *, min(line_no) OVER (PARTITION BY community_id) AS first FROM cl) WHERE s BETWEEN 1 AND 9")
def a14(spark, d):
    lines = materialize(lines_of_context(spark, d), "context")
    return context.sections(lines.withColumn("file", F.lit("all")))


@query("a15_sentences", PROPS + PATHS + r"""
SELECT 'triple' AS kind, '[' || sn || '] (' || st || ') --(' || edge_type || ')--> [' || onm || '] (' || ot || ')' || chr(10) || '  community: ' || community_id || CASE WHEN chunk_id <> 0 THEN '  chunk: ' || chunk_id ELSE '' END || chr(10) || '  weight: ' || weight AS sentence FROM tr
UNION ALL SELECT 'path', 'PATH: [' || c_name || '] (Customer) --(LOCATED_IN)--> [' || n_name || '] (Nation) --(PART_OF)--> [' || r_name || '] (Region)' || chr(10) || '  communities: ' || n_name || chr(10) || '  [via] kind: k PART_OF, via: n' FROM pt
UNION ALL SELECT 'evidence', 'EVIDENCE: "' || evidence_quote || '"' || CASE WHEN text <> evidence_quote THEN chr(10) || 'SOURCE TEXT: "' || CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END || '"' ELSE '' END
  || chr(10) || '  entities: ' || subject || ', ' || object || '  |  predicates: ' || predicate || CASE WHEN chunk_id <> 0 THEN '  |  chunk: ' || chunk_id ELSE '' END FROM raw JOIN documents USING (doc_id)
UNION ALL SELECT 'other', concat_ws(chr(10), CASE WHEN item_brand <> '' THEN 'brand: ' || item_brand END, 'item: ' || item_id, CASE WHEN item_name <> '' THEN 'name: ' || item_name END) FROM (SELECT item_id, name AS item_name, brand AS item_brand FROM items) WHERE item_id IS NOT NULL""")
def a15(spark, d):
    c = F.col
    triples = slim(spark, d).select(F.lit("triple").alias("kind"), context.triple_sentence(c("subject"), c("predicate"), c("object"), c("community_id"), c("chunk_id"), c("properties")).alias("sentence"))
    paths = results.slim_paths(*place_paths(spark, d)).select(F.lit("path"), context.path_sentence(c("chain"), c("predicates"), c("community_ids"), F.array(context.edge_note(F.lit("via"), c("properties")))))
    quotes = context.quotes_in_texts(table(spark, d, "documents"), views.triples_of)
    evidence = quotes.select(F.lit("evidence"), context.evidence_sentence(c("evidence_quote"), F.lit(None).cast("string"), c("text"), F.array("subject", "object"), F.array("predicate"), F.lit(None).cast("string"), c("chunk_id")))
    items = table(spark, d, "items").where("item_id IS NOT NULL")
    other = items.select(F.lit("other"), context.value_sentence(F.create_map(F.lit("item"), c("item_id").cast("string"), F.lit("name"), c("name"), F.lit("brand"), c("brand"))))
    return triples.unionAll(paths).unionAll(evidence).unionAll(other)


@query("s23_results_back")
def s23(spark, d):
    """A report of all vendors is written and its results are read back."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    rows = table(spark, d, "vendors").select(F.col("vendor_id").cast("long").alias("pos"), "vendor_id", "name", "nation_id", "balance").where("pos IS NOT NULL")
    reports.report(rows, "vendors", "all vendors").select("line").write.text(folder)
    return reports.results_in(spark, folder, "*.txt").drop("path")
