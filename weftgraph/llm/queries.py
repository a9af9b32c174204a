"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.materialize import discard, materialize, shared_dir

from . import bpe, chat_format, cover_tree, decontaminate, erasure, html_main, lang_id, license_scan, line_dedup, ngram_join, prefix_trie, token_files, toxicity
from ._frame import held_out, table, train_part

#: The vocabulary of the BPE query; a file that the driver reads.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_pairs(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(train_part()))
    return lang_id.predict(docs.withColumn("held_out", held_out()), model, keep=("held_out",))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_format.other_replies(chat_format.turns(table(spark, sf_dir, "conversations")))
    pairs = chosen.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"))
    return chat_format.preferences(chosen, pairs, rejected=rejected)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_rows(docs.where(train_part()), labels))
    scored = toxicity.score(docs.withColumn("held_out", held_out()), model, keep=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


#: The shop's foreign keys, from the masters of clients on.
SHOP = [
    erasure.Relation("masters", "clients", "master_id", "client_id"),
    erasure.Relation("clients", "clicks", "client_id"),
    erasure.Relation("clients", "sales", "client_id", "sale_id"),
    erasure.Relation("sales", "sale_lines", "sale_id"),
]
#: The columns of each table of the shop that name a row and that hold money.
SHOP_COLUMNS = {"clients": ("client_id", "balance"), "clicks": ("click_id", "value"), "sales": ("sale_id", "total"), "sale_lines": ("sale_id", "amount")}


def _crc(column: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))


def op11_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"
    tables = {name: table(spark, sf_dir, name) for name in SHOP_COLUMNS}
    # a written table: the join with the lines has no aggregate beside it, so Spark can split a hot sale
    owners = materialize(tables["sales"].groupBy("sale_id").agg(F.min("client_id").alias("_weft_client")), "owners")
    paths = {}
    for name, df in tables.items():
        rows = df.join(owners, "sale_id", "left") if name == "sale_lines" else df
        first = _crc("_weft_client" if name == "sale_lines" else "client_id")
        paths[name] = erasure.write_sorted(rows, f"{folder}/{name}", 1 + df.count() // 150, [first], df.columns)
    discard(owners)
    masters = tables["clients"].select(F.col("master_id").alias("key")).where("key IS NOT NULL").distinct().where(_crc("key") % 100 == 0)
    busy = erasure.busiest(tables["clients"], tables["clicks"], "master_id", "client_id")
    victims = erasure.cascade(tables, SHOP, {"masters": masters.unionAll(busy)})
    out = None
    for name, (first, money) in SHOP_COLUMNS.items():
        final = erasure.rewrite(spark, f"{folder}/{name}", paths[name], SHOP, name, victims)
        if not final:
            continue
        rows = [(no, gone, path != paths[name][no], name, ",".join(tables[name].columns), path) for no, (path, gone) in final.items()]
        told = spark.createDataFrame(rows, "file_no long, n_erased long, rewritten boolean, table_name string, columns string, path string")
        digests = erasure.file_digests(spark, {no: path for no, (path, _) in final.items()}, first, money)
        files = told.join(digests, "file_no")
        out = files if out is None else out.unionByName(files)
    return spark.createDataFrame([], "file_no long, n_erased long, rewritten boolean, table_name string, columns string, path string, n_rows long, cents long, ids_sha256 string") if out is None else out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebranched(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), VOCABULARY, folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_chat_preferences": op5_chat_preferences,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_html_main_text": op10_html_main_text,
    "op11_cascading_erasure": op11_cascading_erasure,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}

ORACLES: dict[str, str] = {
    "op1_cover_tree": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings WHERE vec_id IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op5_chat_preferences": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id),
y AS (SELECT t.conv_id, t.text FROM t JOIN a ON a.conv_id = t.conv_id AND a.last = t.k),
s AS (SELECT t.conv_id, 0 AS side, t.k, t.role, t.text FROM t JOIN a USING (conv_id) WHERE a.last IS NULL OR t.k <= a.last
      UNION ALL SELECT t.conv_id, 1, t.k, t.role, t.text FROM t JOIN a USING (conv_id) WHERE a.last IS NULL OR t.k < a.last
      UNION ALL SELECT a.conv_id, 1, a.last, 'assistant', coalesce(y.text, '') FROM a LEFT JOIN y ON y.conv_id = a.conv_id + 1 WHERE a.last IS NOT NULL),
d AS (SELECT x.conv_id AS chosen_id, x.conv_id AS rejected_id,
             coalesce(min(x.k) FILTER (WHERE x.role <> z.role OR x.text <> z.text) - 1, count(*))::BIGINT AS n_common
      FROM s x JOIN s z ON z.conv_id = x.conv_id AND z.k = x.k AND z.side = 1 WHERE x.side = 0 GROUP BY x.conv_id),
r AS (SELECT d.*, s.side, s.k, s.role, s.text, '<|im_start|>' || s.role || chr(10) || s.text || '<|im_end|>' || chr(10) AS shown
      FROM d JOIN s ON s.conv_id = d.chosen_id),
q AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY chosen_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r WHERE k > n_common)
SELECT d.chosen_id, d.rejected_id, d.n_common,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM r WHERE r.chosen_id = d.chosen_id AND side = 0 AND k <= r.n_common), '') AS prompt,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM q WHERE q.chosen_id = d.chosen_id AND side = 0), '') AS chosen,
  coalesce((SELECT string_agg(shown, '' ORDER BY k) FROM q WHERE q.chosen_id = d.chosen_id AND side = 1), '') AS rejected,
  coalesce((SELECT string_agg((before + 13 + length(role))::BIGINT || '-' || (before + length(shown) - 1)::BIGINT, ',' ORDER BY k) FROM q WHERE q.chosen_id = d.chosen_id AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg((before + 13 + length(role))::BIGINT || '-' || (before + length(shown) - 1)::BIGINT, ',' ORDER BY k) FROM q WHERE q.chosen_id = d.chosen_id AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM d
""",
    "op6_line_dedup": r"""
WITH a AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, i - 1 AS i, trim(x, ' ') AS x FROM (SELECT doc_id, text, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM a)),
p AS (SELECT doc_id, text, i, x, row_number() OVER (PARTITION BY doc_id, text ORDER BY i) - 1 AS j,
             length(x) - length(replace(x, ' ', '')) + 1 AS w FROM l WHERE x <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY j) AS upto, sum(w) OVER (PARTITION BY doc_id, text ORDER BY j) - w AS before FROM p),
s AS (SELECT *, count(*) OVER f AS tf, sum(w) OVER f AS wf, count(*) OVER b AS tb, sum(w) OVER b AS wb FROM c
      WINDOW f AS (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
             b AS (PARTITION BY doc_id, text ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
n AS (SELECT doc_id, text, j, tf AS t FROM s WHERE wf >= 50 UNION SELECT doc_id, text, j - tb + 1, tb FROM s WHERE wb >= 50),
d AS (SELECT doc_id, text, list(x ORDER BY j) AS xs FROM p GROUP BY doc_id, text),
k AS (SELECT n.*, array_to_string(d.xs[(n.j + 1):(n.j + n.t)], chr(10)) AS key FROM n JOIN d USING (doc_id, text)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, text, j) AS o FROM k),
g AS (SELECT DISTINCT doc_id, text, unnest(generate_series(j, j + t - 1)) AS j FROM r WHERE o > 1),
q AS (SELECT p.doc_id, p.text, p.i FROM p JOIN g USING (doc_id, text, j)),
o AS (SELECT l.doc_id, l.text, string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE q.i IS NULL) AS kept, count(q.i) AS n FROM
      (SELECT doc_id, text, i - 1 AS i, raw FROM (SELECT doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM a)) l
      LEFT JOIN q ON q.doc_id = l.doc_id AND q.text = l.text AND q.i = l.i GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(o.kept, '') AS text, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, o.n::BIGINT AS n_deleted
FROM documents d JOIN o ON o.doc_id = d.doc_id AND o.text = d.text
""",
    "op12_prefix_trie": r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM s, crc),
b AS (SELECT h.*, least(h.h, coalesce(s.n, 0)) AS lead FROM h LEFT JOIN s ON s.conv_id = h.conv_id - h.conv_id % 5),
u AS (SELECT b.conv_id, pos - h + lead AS pos, r, x FROM b JOIN t USING (conv_id) WHERE pos >= h
      UNION ALL SELECT b.conv_id, pos, r, x FROM b JOIN t ON t.conv_id = b.conv_id - b.conv_id % 5 AND pos < lead),
p AS (SELECT conv_id, pos + 1 AS depth, octet_length(encode(x)) AS bytes, string_agg(sha256(length(r) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM u
      UNION ALL SELECT conv_id, 0, 0, '' FROM s),
e AS (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM p GROUP BY conv_id),
ends AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM e GROUP BY depth, key),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY depth, key),
c AS (SELECT depth - 1 AS depth, left(key, 64 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, sha256(coalesce(ends.ids, '')) AS ends FROM n LEFT JOIN c USING (depth, key) LEFT JOIN ends USING (depth, key)),
a AS (SELECT g AS depth, left(key, 64 * g) AS key, count(*) FILTER (WHERE n_children = 0) AS leaves, sum((n - 1) * bytes) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS g FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN a USING (depth, key) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.key = left(f.key, 64 * (f.depth - 1))
""",
}
