"""Registered queries of calls, resumed stages, values of unknown shape and evidence by direction, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import uuid5_zero
from weftgraph.operators import calls, diagnostics, evidence, nested
from weftgraph.plans import refine, stages, views
from weftgraph.plans.materialize import shared_dir
from weftgraph.plans.views import table
from weftgraph.plans.stages import Stage
from weftgraph.queries import _coverage as chunk_coverage
from weftgraph.queries import query


def _new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clicks(spark, d) -> DataFrame:
    return table(spark, d, "clicks").select("click_id", "props").distinct()


@query("n02_leaves", """SELECT click_id, t.fullkey AS path, CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, json_extract_string(props, t.fullkey) AS value
FROM (SELECT DISTINCT click_id, props FROM clicks WHERE json_valid(props)) c, json_tree(c.props) t WHERE t.atom IS NOT NULL""")
def n02(spark, d):
    return nested.leaves(clicks(spark, d), "props", ["click_id"]).drop("place")


@query("v13_all_text", """SELECT props, string_agg(json_extract_string(props, t.fullkey), ' ' ORDER BY t.fullkey) AS text
FROM (SELECT DISTINCT props FROM clicks WHERE json_valid(props)) c, json_tree(c.props) t WHERE t.type = 'VARCHAR' GROUP BY props""")
def v13(spark, d):
    rows = table(spark, d, "clicks").select("props").distinct()
    return nested.all_text(nested.leaves(rows, "props", ["props"]), ["props"])


@query("a07_distinct_values", """SELECT count(*) AS n, min(click_id) AS first FROM (
  SELECT click_id, coalesce(s, props) AS value FROM clicks LEFT JOIN (SELECT props, string_agg(t.fullkey || ' ' || t.type || ' ' || coalesce(t.atom::VARCHAR, ''), chr(10) ORDER BY t.fullkey) AS s
    FROM (SELECT DISTINCT props FROM clicks WHERE json_valid(props)) c, json_tree(c.props) t GROUP BY props) USING (props) WHERE props IS NOT NULL) GROUP BY value""")
def a07(spark, d):
    return nested.distinct_values(table(spark, d, "clicks"), "props", "click_id").select("n", "first")


@query("e02_merged_by_vector", """SELECT b.id, label % 4 AS community_id, label AS chunk_id, string_agg(DISTINCT 'e' || vec_id % 7, ',' ORDER BY 'e' || vec_id % 7) AS entities, b.new = 1 AS is_new, count(*) AS n_points FROM (
  WITH p AS (SELECT vec_id, label, 'v' || vec_id AS id, vec_id % 2 AS new, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
             UNION ALL SELECT vec_id, label, 'x' || vec_id, 1, list_transform(embedding, lambda x: 3 * x::DOUBLE) FROM embeddings WHERE vec_id % 5 = 0),
  f AS (SELECT a.id, min({'new': b.new, 'id': b.id}) AS b FROM p a JOIN p b ON a.label IS NOT DISTINCT FROM b.label AND list_cosine_similarity(a.e, b.e) >= 1 - 1e-12 GROUP BY a.id)
  SELECT vec_id, label, coalesce(f.b, {'new': p.new, 'id': p.id}) AS b FROM p LEFT JOIN f USING (id)) GROUP BY b, label""")
def e02_by_vector(spark, d):
    rows = table(spark, d, "embeddings")
    own = lambda t, name, vec, new: t.select(F.concat(F.lit(name), "vec_id").alias("id"), vec.alias("vec"), (F.col("label") % 4).alias("community_id"), F.col("label").alias("chunk_id"), F.array(F.concat(F.lit("e"), F.col("vec_id") % 7)).alias("entities"), F.array(F.lit("p")).alias("predicates"), new.alias("new"))
    vec = F.col("embedding").cast("array<double>")
    p = own(rows, "v", vec, F.col("vec_id") % 2).unionAll(own(rows.where("vec_id % 5 = 0"), "x", F.transform(vec, lambda x: 3 * x), F.lit(1).cast("long")))
    out = evidence.merge_by_direction(p.where("new = 0").drop("new"), p.where("new = 1").drop("new"))
    return out.select("id", "community_id", "chunk_id", F.array_join("entities", ",").alias("entities"), "is_new", "n_points")


def _answer(request: str) -> str:
    """Stands for a model: the word marked as English; it fails for words of seven characters."""
    if len(request) == 7:
        raise ValueError("no translation")
    return f"en {request}"


@query("x06_answered_calls", """SELECT doc_id, triple_no, predicate, CASE WHEN length(predicate) <> 7 THEN 'en ' || predicate END AS predicate_en, CASE WHEN length(predicate) = 7 THEN 'ValueError: no translation' END AS error, (CASE WHEN length(predicate) = 7 THEN 2 ELSE 1 END)::INTEGER AS tries FROM raw""")
def x06(spark, d):
    rows = views.raw_triples(spark, d).select("doc_id", "triple_no", "predicate")
    policy = calls.Policy(tries=2, first_wait=0.0)
    return calls.answered(rows, _answer, _new_folder(spark, "answers"), "predicate", policy).withColumnRenamed("answer", "predicate_en")


def _resolve(kind: str, rows: DataFrame) -> DataFrame:
    """Stands for the decisions of a model: long names get a canonical form, the others stay."""
    known = rows.where(F.length("name") > {"entity": 2, "predicate": 3, "label": 1}[kind])
    return known.withColumns({"canonical": F.concat(F.lit(kind[0] + ":"), "name"), "canonical_id": uuid5_zero(F.col("name"))})


def _labelled_triples(documents: DataFrame) -> DataFrame:
    t = views.triples_of(documents)
    label = lambda c: F.concat(F.when(F.length(c) % 3 == 0, "").otherwise("L"), F.when(F.length(c) % 3 == 1, F.length(c).cast("string")).otherwise(""))
    return t.select("doc_id", "triple_no", "subject", "predicate", "object", "evidence_quote", F.col("doc_id").cast("string").alias("community_id"), "chunk_id", label("subject").alias("subject_label"), label("object").alias("object_label"))


def _refined(spark, d) -> tuple[dict[str, DataFrame], str]:
    folder, inputs = _new_folder(spark, "refined"), {"documents": table(spark, d, "documents")}
    steps = [Stage("triples", lambda t: _labelled_triples(t["documents"]), ("documents",)), *refine.stages(_resolve)]
    marks = {"documents": stages.content_fingerprint(inputs["documents"])}
    stages.resumed(spark, steps[:3], inputs, folder, marks)  # as a run that ended half way
    return stages.resumed(spark, steps, inputs, folder, marks), folder


LABEL = "(CASE WHEN length({0}) % 3 = 0 THEN '' WHEN length({0}) % 3 = 1 THEN 'L' || length({0}) ELSE 'L' END)"
LABELLED = f", lab AS (SELECT *, {LABEL.format('subject')} AS sl, {LABEL.format('object')} AS ol FROM raw)"


@query("r15_refined_run", LABELLED + """ SELECT doc_id, triple_no, CASE WHEN length(subject) > 2 THEN 'e:' || subject ELSE subject END AS subject_name, CASE WHEN length(object) > 2 THEN 'e:' || object ELSE object END AS object_name,
CASE WHEN length(predicate) > 3 THEN 'p:' || predicate ELSE predicate END AS predicate_name, CASE WHEN length(sl) > 1 THEN 'l:' || sl ELSE sl END AS subject_label_name, CASE WHEN length(ol) > 1 THEN 'l:' || ol ELSE ol END AS object_label_name FROM lab""")
def r15(spark, d):
    return _refined(spark, d)[0]["refined"].select("doc_id", "triple_no", "subject_name", "object_name", "predicate_name", "subject_label_name", "object_label_name")


@query("y05_stage_states", LABELLED + """ SELECT 'triples' AS stage, 'reused' AS status, count(*) AS n_rows FROM raw UNION ALL SELECT 'evidence', 'reused', count(*) FROM (SELECT DISTINCT evidence_quote, doc_id, chunk_id FROM raw)
UNION ALL SELECT 'entity', 'reused', count(*) FROM (SELECT subject AS x FROM raw UNION SELECT object FROM raw) WHERE length(x) > 2
UNION ALL SELECT 'predicate', 'done', count(*) FROM (SELECT DISTINCT predicate, doc_id FROM raw WHERE length(predicate) > 3)
UNION ALL SELECT 'label', 'done', count(*) FROM (SELECT sl AS x FROM lab UNION SELECT ol FROM lab) WHERE length(x) > 1
UNION ALL SELECT 'refined', 'done', count(*) FROM raw""")
def y05(spark, d):
    return stages.states(spark, _refined(spark, d)[1]).select("stage", "status", "n_rows")


@query("h01_quote_details", r"""SELECT doc_id, chunk_id, sum(len(regexp_split_to_array(trim(q, ' '), '\s+')))::BIGINT AS quote_words, string_agg(length(q), ',' ORDER BY length(q) DESC) AS quote_lengths
FROM (SELECT DISTINCT doc_id, chunk_id, evidence_quote AS q FROM raw WHERE trim(evidence_quote, ' ') <> '') GROUP BY 1, 2""")
def h01_details(spark, d):
    out = diagnostics.quote_details(views.raw_triples(spark, d))
    return out.withColumn("quote_lengths", F.array_join(F.col("quote_lengths").cast("array<string>"), ","))


@query("h02_coverage_extremes", """(SELECT 'best' AS extreme, doc_id, chunk_id, round(coverage, 6) AS coverage FROM coverage ORDER BY coverage DESC, doc_id, chunk_id LIMIT 1)
UNION ALL (SELECT 'worst', doc_id, chunk_id, round(coverage, 6) FROM coverage ORDER BY coverage, doc_id, chunk_id LIMIT 1)""")
def h02_extremes(spark, d):
    return diagnostics.coverage_extremes(chunk_coverage(spark, d)).withColumn("coverage", F.round("coverage", 6))
