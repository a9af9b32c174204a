"""The context of an answer as numbered lines, its way back into sections, and results as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from weftgraph.operators.ranking import numbered, per_group
from weftgraph.plans.materialize import materialize

#: The lines of a context and the marks in it.
START, END, SHUT = "<!-- COMMUNITY_START: ", "<!-- COMMUNITY_END: ", " -->"
RELATIONS, CONTENT = "## relationships\n", "## relevant content (references for relationships)\n"
NO_TEXT = "*No reference chunk text available for this community*\n"
CUT = "\n\n[truncated — community content cap reached]"
LEFT_OUT = " more chunk(s) omitted — community content cap reached]*"
NO_PATH, NO_EVIDENCE, NO_RESULT, LONGEST = "[empty path]", "[empty evidence]", "[empty result]", 600

#: Lines of a file that meet the sections around them in one group of a join.
BLOCK = 256


def budgeted(texts: DataFrame, by: str, order: list[str], budget: int = 8000) -> tuple[DataFrame, DataFrame]:
    """Texts under a running budget of characters with ``place`` from 1, and ``by, n_omitted`` of groups with texts beyond it.

    The text that crosses the budget is cut and says so; later ones are counted. Null and empty texts are none.
    ``order`` has no equals in a group. Ranges of the order are summed apart, so a large group is no large task, and
    ranges that begin beyond the budget are not sorted at all.
    """
    own = texts.where(F.col("text") != "").select(by, *order, "text")
    spread = materialize(own.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "texts")
    sums = spread.groupBy(by, "_range").agg(F.sum(F.length("text")).alias("_n"), F.count("*").alias("_c"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_n", "_start"), ("_c", "_first"))))
    inside = Window.partitionBy(by, "_range").orderBy(*order)
    used = F.col("_start") + F.coalesce(F.sum(F.length("text")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = spread.join(starts.where(F.col("_start") < budget), [by, "_range"])
    near = near.withColumn("_room", budget - used).withColumn("place", F.col("_first") + F.row_number().over(inside)).where("_room > 0")
    cut = F.concat(F.substring(F.col("text"), F.lit(1), F.col("_room").cast("int")), F.lit(CUT))
    kept = near.select(by, *order, "place", F.when(F.length("text") > F.col("_room"), cut).otherwise(F.col("text")).alias("text"))
    total = sums.groupBy(by).agg(F.sum("_c").alias("_c"))
    omitted = total.join(kept.groupBy(by).agg(F.count("*").alias("_k")), by).select(by, (F.col("_c") - F.col("_k")).alias("n_omitted")).where("n_omitted > 0")
    return kept, omitted


def context_lines(results: DataFrame, links: DataFrame, texts: DataFrame, order: list[str], labels: DataFrame | None = None, cap: int = 50, budget: int = 8000) -> DataFrame:
    """``line_no, line``: for each community its best results, the links of their names, and texts under a budget, between marks.

    ``results`` has ``community_id, result_id, score, line`` (a null line has none), one row for each community of a
    result; ``links`` ``result_id, line``, of which equal ones of a community stay once, where the best result has them;
    ``texts`` ``community_id, text`` and the columns of ``order``; ``labels`` ``community_id, label``. Communities stand in the order of their best result. Lines
    are numbered from 1 over all communities; texts and lines with breaks become several.
    """
    best = materialize(per_group(results, "community_id", "score", "result_id", cap), "best")
    groups = best.where("rank = 1").select("community_id", "group_rank")
    of = lambda rows: rows.join(groups, "community_id")
    part = lambda rows, section, line, k=F.lit(0), t=F.lit(""): rows.select("group_rank", F.lit(section).alias("s"), k.cast("long").alias("k"), t.alias("t"), line.alias("line"))
    cid = F.col("community_id")
    named = groups.join(labels, "community_id", "left") if labels is not None else groups.withColumn("label", F.lit(None).cast("string"))
    title = F.when(F.col("label") != "", F.concat(F.lit("# "), "label", F.lit(" (internal id: "), cid, F.lit(")\n"))).otherwise(F.concat(F.lit("# "), cid, F.lit("\n")))
    used = best.join(links.withColumnRenamed("line", "_link"), "result_id").groupBy("group_rank", "_link").agg(F.min("rank").alias("k"))
    kept, omitted = budgeted(texts.join(groups.select("community_id"), "community_id"), "community_id", order, budget)
    kept = materialize(of(kept), "kept")
    without = groups.join(kept.select("community_id").distinct(), "community_id", "left_anti")
    parts = [
        part(groups, 0, F.concat(F.lit(START), cid, F.lit(SHUT))), part(named, 1, title), part(groups, 2, F.lit(RELATIONS)),
        part(best.where("line IS NOT NULL"), 3, F.col("line"), F.col("rank")), part(used.select("group_rank").distinct(), 4, F.lit("")), part(used, 5, F.col("_link"), F.col("k"), F.col("_link")),
        part(groups, 6, F.lit("")), part(groups, 7, F.lit(CONTENT)), part(kept, 8, F.concat("text", F.lit("\n")), F.col("place")), part(without, 8, F.lit(NO_TEXT)),
        part(of(omitted), 9, F.concat(F.lit("*["), F.col("n_omitted").cast("string"), F.lit(LEFT_OUT))), part(groups, 10, F.concat(F.lit(END), cid, F.lit(SHUT + "\n"))),
    ]
    whole = parts[0]
    for rows in parts[1:]:
        whole = whole.unionAll(rows)
    lines = whole.select("group_rank", "s", "k", "t", F.posexplode(F.split("line", "\n")).alias("i", "line"))
    placed = materialize(lines.select(F.struct("group_rank", "s", "k", "t", "i").alias("_at"), "line"), "lines")  # the range sort reads its rows twice
    return numbered(placed, "_at", "line_no").select(F.col("line_no").cast("long").alias("line_no"), "line")


@F.udtf(returnType="file string, community_id string, first long, last long")
class _Apart:
    """Of the spans of one file in order, those that begin behind the last one taken; nothing else is held."""

    def __init__(self):
        self.end = -1

    def eval(self, row: Row):
        if row["first"] > self.end:
            self.end = row["last"]
            yield row["file"], row["community_id"], row["first"], row["last"]


def sections(lines: DataFrame, file: str = "file") -> DataFrame:
    """``file, community_id, first, line_no, line``: the lines between the marks of a context, whose mark stands at ``first``.

    ``lines`` has ``file`` (text), ``line_no`` and ``line``. A section ends at the first mark of its own community; marks of
    others inside are lines of it. A mark without an end opens nothing, so what follows is looked at on its own; marks count if
    they are whole lines. Only marks are read in order, lines meet their section by blocks of a file.
    """
    own = lines.select(F.col(file).cast("string").alias("file"), F.col("line_no").cast("long").alias("line_no"), "line")
    mark = r"^<!-- COMMUNITY_(START|END): (.*) -->$"
    marks = own.where(F.col("line").startswith("<!-- COMMUNITY_")).select("file", "line_no", F.regexp_extract("line", mark, 1).alias("kind"), F.regexp_extract("line", mark, 2).alias("community_id")).where("kind <> ''")
    ahead = Window.partitionBy("file", "community_id").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spans = marks.withColumn("last", F.min(F.when(F.col("kind") == "END", F.col("line_no"))).over(ahead)).where("kind = 'START' AND last IS NOT NULL")
    spans = spans.select("file", "community_id", F.col("line_no").alias("first"), "last")
    taken = _Apart(spans.asTable().partitionBy("file").orderBy("first"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    near = taken.withColumn("_block", F.explode(F.sequence(block("first"), block("last"))))
    found = own.withColumn("_block", block("line_no")).join(near, ["file", "_block"]).where("line_no > first AND line_no < last")
    return found.select("file", "community_id", "first", "line_no", "line")


def section_texts(found: DataFrame) -> DataFrame:
    """``file, community_id, first, text``: a section as one text without white space around it; one value a section, as its callers need."""
    one = found.groupBy("file", "community_id", "first").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return one.select("file", "community_id", "first", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _meta(separator: str, *parts: tuple[str, Column]) -> Column:
    """``name: value`` of the values that are not null, empty or 0, below the line; null if there are none."""
    shown = F.concat_ws(separator, *(F.when((value.cast("string") != "") & (value.cast("string") != "0"), F.concat(F.lit(f"{name}: "), value.cast("string"))) for name, value in parts))
    return F.when(shown != "", F.concat(F.lit("  "), shown))


def _pairs(properties: Column, separator: str) -> Column:
    """``key: value`` of a map's values that are not null, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v.isNotNull()))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), separator)


def _node(node: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(node["name"], F.lit("?")), F.lit("]"), F.when(node["type"] != "", F.concat(F.lit(" ("), node["type"], F.lit(")"))).otherwise(""))


def triple_sentence(subject: Column, predicate: Column, object: Column, community: Column, chunk: Column, properties: Column) -> Column:
    """``[a] (type) --(p)--> [b] (type)``, below it community and chunk, below these the properties."""
    own = _pairs(properties, "  ")
    head = F.concat(_node(subject), F.lit(" --("), F.coalesce(predicate, F.lit("?")), F.lit(")--> "), _node(object))
    return _lines(head, _meta("  ", ("community", community), ("chunk", chunk)), F.when(own != "", F.concat(F.lit("  "), own)))


def path_sentence(chain: Column, predicates: Column, communities: Column, notes: Column) -> Column:
    """``PATH: [a] --(p)--> [b]``, below it the communities and the ``notes`` of its edges (an array of ``[p] key: value``)."""
    steps = F.transform(chain, lambda x, i: F.concat(_node(x), F.coalesce(F.concat(F.lit(" --("), F.get(predicates, i), F.lit(")-->")), F.lit(""))))
    noted = F.array_join(F.filter(notes, lambda x: x != ""), "  ")
    whole = _lines(F.concat(F.lit("PATH: "), F.array_join(steps, " ")), _meta("  ", ("communities", F.array_join(communities, ", "))), F.when(noted != "", F.concat(F.lit("  "), noted)))
    return F.when(F.size(chain) > 0, whole).otherwise(NO_PATH)


def edge_note(predicate: Column, properties: Column) -> Column:
    """``[p] key: value, key: value``; empty without properties."""
    own = _pairs(properties, ", ")
    return F.when(own != "", F.concat(F.lit("["), predicate, F.lit("] "), own)).otherwise("")


def evidence_sentence(quote: Column, quote_en: Column, text: Column, entities: Column, predicates: Column, community: Column, chunk: Column) -> Column:
    """The English quote and the original, or the only one; the text if it is another (shown up to 600 characters); names, community and chunk."""
    said = lambda name, c: F.concat(F.lit(f'{name}: "'), c, F.lit('"'))
    original, english, source = (F.coalesce(c, F.lit("")) for c in (quote, quote_en, text))
    shown = F.when(F.length(source) > LONGEST, F.concat(F.substring(source, 1, LONGEST), F.lit("…"))).otherwise(source)
    out = _lines(
        F.when(english != "", said("EVIDENCE (EN)", english)),
        F.when((english != "") & (original != "") & (original != english), said("EVIDENCE (original)", original)).when((english == "") & (original != ""), said("EVIDENCE", original)),
        F.when((source != "") & (source != original), said("SOURCE TEXT", shown)),
        _meta("  |  ", ("entities", F.array_join(entities, ", ")), ("predicates", F.array_join(predicates, ", ")), ("community", community), ("chunk", chunk)),
    )
    return F.when(out != "", out).otherwise(NO_EVIDENCE)


def quotes_in_texts(documents: DataFrame, triples_of) -> DataFrame:
    """``triples_of`` the documents with ``text`` beside each quote as ``evidence_sentence`` shows it: what it tells apart is kept, not the whole text.

    A document's triples have its text in their row. Only documents with equal ids, whose triples have all of their texts, are joined.
    """
    own = documents.where("doc_id IS NOT NULL")
    again = materialize(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    head = F.substring("text", 1, LONGEST + 1)
    shown = own.select("doc_id", "text", head.alias("_head"), (F.instr("text", "\n") == 0).alias("_one"))
    single = shown.join(F.broadcast(again), "doc_id", "left_anti")
    found = triples_of(single.select(F.struct("doc_id", "_head", "_one").alias("doc_id"), "text")).withColumns({"_head": F.col("doc_id._head"), "_one": F.col("doc_id._one"), "doc_id": F.col("doc_id.doc_id")})
    if not again.isEmpty():
        several = shown.join(F.broadcast(again), "doc_id", "left_semi")
        found = found.unionByName(triples_of(several).join(several.select("doc_id", "_head", "_one", F.col("text").alias("_text")), "doc_id").withColumn("_one", F.col("_text") == F.col("evidence_quote")).drop("_text"))
    quote = F.col("evidence_quote")
    # a longer text that begins with the quote is another text
    text = F.when(F.col("_one"), quote).when(F.col("_head") == quote, F.concat("_head", F.lit("\n"))).otherwise(F.col("_head"))
    return found.withColumn("text", text).drop("_head", "_one")


def value_sentence(values: Column) -> Column:
    """``key: value`` lines of a map's values that are not null or empty, by key."""
    out = _pairs(F.map_filter(values, lambda k, v: v != ""), "\n")
    return F.when(out != "", out).otherwise(NO_RESULT)
