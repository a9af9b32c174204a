"""Post-processing of extracted triples: evidence, dictionaries, registries, refined output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import strip, uuid5_zero


def evidence_quote(content: Column, start: Column, end: Column, least: int = 3) -> Column:
    """Lines start..end of a chunk, widened to ``least`` lines and then clamped, joined and stripped."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    s = F.coalesce(start, F.lit(1))
    e = F.greatest(F.coalesce(end, s), s + least - 1)
    s = F.least(F.greatest(s, F.lit(1)), n)
    e = F.least(F.greatest(e, s), n)
    return strip(F.array_join(F.slice(lines, s, e - s + 1), "\n"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a minimum over an ordered struct, so partial aggregation bounds hot keys."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in [*order, *rest]))


def dictionary(values: DataFrame, order: list[str]) -> DataFrame:
    """Distinct (role, value) with the position at which each is first seen."""
    return first_by(values, ["role", "value"], order)


def remap(triples: DataFrame, translated: DataFrame, roles: list[str]) -> DataFrame:
    """A column ``<role>_en`` for each role, from the dictionary's ``role, value, value_en``."""
    out = triples
    for role in roles:
        own = translated.where(F.col("role") == role).select(F.col("value").alias(role), F.col("value_en").alias(f"{role}_en"))
        out = out.join(own, role, "left")
    return out


def failed_translation(value: Column, english: Column) -> Column:
    """Missing, blank, or an echo of the source."""
    return english.isNull() | (F.trim(english) == "") | (F.lower(F.trim(english)) == F.lower(F.trim(value)))


def evidence_groups(triples: DataFrame) -> DataFrame:
    """One row for each quote, community and chunk: the sorted sets of its entities and predicates.

    ``triples`` has ``community_id, chunk_id, subject, predicate, object, evidence_quote``.
    """
    keys = [F.col("evidence_quote"), F.col("community_id"), F.col("chunk_id").cast("string").alias("chunk_id")]
    sets = [F.collect_set(c).alias(f"_{c}") for c in ("subject", "object", "predicate")]  # a quote is shuffled once, not for each of its ends
    grouped = triples.select(*keys, "subject", "object", "predicate").groupBy("evidence_quote", "community_id", "chunk_id").agg(*sets)
    grouped = grouped.select("evidence_quote", "community_id", "chunk_id", F.array_sort(F.array_union("_subject", "_object")).alias("entities"), F.array_sort("_predicate").alias("predicates"))
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return grouped.withColumn("id", uuid5_zero(F.concat_ws("::", F.col("evidence_quote"), text("community_id"), text("chunk_id"))))


def refined(triples: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """Triples with canonical names and ids; without a resolution the name stays and the id is null.

    ``entities`` has ``name, canonical, canonical_id``, ``predicates`` also ``community_id``.
    """
    s = entities.select(F.col("name").alias("subject"), F.col("canonical").alias("subject_name"), F.col("canonical_id").alias("subject_id"))
    o = entities.select(F.col("name").alias("object"), F.col("canonical").alias("object_name"), F.col("canonical_id").alias("object_id"))
    p = predicates.select(F.col("name").alias("predicate"), "community_id", F.col("canonical").alias("predicate_name"), F.col("canonical_id").alias("predicate_id"))
    out = triples.join(s, "subject", "left").join(o, "object", "left").join(p, ["predicate", "community_id"], "left")
    return out.withColumns({f"{r}_name": F.coalesce(f"{r}_name", r) for r in ("subject", "object", "predicate")})


def replace_chunk(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The triples of the chunks in ``new`` take the place of the existing ones."""
    return existing.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(new)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of rows with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def merge_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence points (``id, quote_en, community_id, chunk_id, entities, predicates``): those with one English quote, community
    and chunk are one, with the sorted union of their lists and the id that was there first."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = rows.groupBy("quote_en", "community_id", "chunk_id").agg(F.min(F.struct("_new", "id")).alias("b"), lists("entities"), lists("predicates"))
    return found.select("b.id", "quote_en", "community_id", "chunk_id", "entities", "predicates", (F.col("b._new") == 1).alias("is_new"))


def evidence_points(evidence: DataFrame) -> DataFrame:
    """Texts to embed: ``dense_text`` (English, else as it is, else a marker) and ``sparse_th`` where another language stands beside."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    marker = F.lit("[no evidence]")
    own = F.coalesce(filled("quote_en"), filled("evidence_quote"), marker)
    return evidence.withColumns({"dense_text": own, "sparse_text": own, "thai_text": F.when(filled("evidence_quote").isNotNull() & (filled("evidence_quote") != F.coalesce(filled("quote_en"), F.lit(""))), F.col("evidence_quote"))})


#: Keys of a triple's properties that do not go to the edge.
EVIDENCE_KEYS = ["evidence_quote", "evidence_quote_en", "causal_link"]


def graph_nodes(triples: DataFrame) -> DataFrame:
    """``canonical_id, name, type`` from triples (``pos, subject, object`` with ``name, name_en, canonical_id, label, type``):
    the id is made from the name where there is none, the first by position and role gives name and type (``Entity`` without any)."""
    ends = triples.select("pos", F.posexplode(F.array("subject", "object")).alias("role", "e")).select("pos", "role", "e.*").where("name IS NOT NULL")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    node = ends.select(F.coalesce(filled("canonical_id"), uuid5_zero(F.coalesce(filled("name_en"), "name"))).alias("canonical_id"), "pos", "role", "name", F.coalesce(filled("label"), filled("type"), F.lit("Entity")).alias("type"))
    return first_by(node, ["canonical_id"], ["pos", "role"]).select("canonical_id", "name", "type")


def graph_edges(triples: DataFrame) -> DataFrame:
    """Edge rows ``pos, src, edge_type, dst, community_id, chunk_id, properties`` of triples; ``error`` says what one lacks."""
    kept = F.map_filter(F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(EVIDENCE_KEYS))
    lacks = lambda c, text: F.when(F.coalesce(F.col(c) == "", F.lit(True)), F.lit(text))
    error = F.concat_ws("; ", lacks("src", "no subject id"), lacks("dst", "no object id"), lacks("edge_type", "no predicate"))
    return triples.select("pos", "src", "edge_type", "dst", "community_id", "chunk_id", F.map_concat(kept, F.create_map(F.lit("chunk_id"), F.coalesce(F.col("chunk_id").cast("string"), F.lit("")))).alias("properties"), F.when(error != "", error).alias("error"))


def new_edges(rows: DataFrame, nodes: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The edges that a merge creates: without error, both ends among the nodes, not there yet, the first row of each (src, edge_type, dst)."""
    ids = nodes.select("canonical_id")
    keys = ["src", "edge_type", "dst"]
    own = rows.join(ids.withColumnRenamed("canonical_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("canonical_id", "dst"), "dst", "left_semi")
    own = own.join(existing.select(keys), keys, "left_anti").withColumn("properties", F.array_sort(F.map_entries("properties")))  # maps have no order
    return first_by(own, keys, order).withColumn("properties", F.map_from_entries("properties"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """``canonical_id, n`` of ids that more than one node has: rows against the uniqueness of ids."""
    return nodes.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1")


def build_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``entities_created, relationships_created, errors`` of a build."""
    good = F.col("error").isNull()
    counts = edges.agg(F.count(F.when(good, 1)).alias("relationships_created"), F.count(F.when(~good, 1)).alias("errors"))
    return nodes.agg(F.count("*").alias("entities_created")).join(counts)


def qualifying_chunks(triples: DataFrame, foreign: Column, by: list[str]) -> DataFrame:
    """``by, qualifies``: whether any triple of the chunk has a field that ``foreign`` finds in need of translation."""
    return triples.groupBy(*by).agg(F.max(F.coalesce(foreign, F.lit(False))).alias("qualifies"))


def translated_chunks(triples: DataFrame, by: list[str], roles: tuple[str, ...] = ("subject", "predicate", "object")) -> DataFrame:
    """``by, complete``: whether every field with a value has a translation that is not blank and no echo."""
    bad = [(F.trim(F.coalesce(r, F.lit(""))) != "") & failed_translation(F.col(r), F.col(f"{r}_en")) for r in roles]
    return triples.groupBy(*by).agg((~F.max(F.greatest(*(b.cast("int") for b in bad)).cast("boolean"))).alias("complete"))


def stamped(triples: DataFrame, community: Column, chunk: Column) -> DataFrame:
    """Triples with the community and chunk they come from."""
    return triples.withColumns({"community_id": community.cast("string"), "chunk_id": chunk.cast("string")})


def one_chunk(chunks: DataFrame, chunk_id: object) -> DataFrame:
    """The chunk to extract again; an error if there is none."""
    own = chunks.where(F.col("chunk_id") == F.lit(chunk_id))
    if own.isEmpty():
        raise ValueError(f"no chunk {chunk_id}")
    return own


def without_english(triples: DataFrame, english: tuple[str, ...] = ("subject_en", "predicate_en", "object_en", "relationship_attributes_en", "evidence_quote_en")) -> DataFrame:
    """Triples before a translation: English fields that are there become null."""
    return triples.withColumns({c: F.lit(None).cast(triples.schema[c].dataType) for c in english if c in triples.columns})


def translated(words: DataFrame, translate, rounds: int = 2) -> DataFrame:
    """``role, value, value_en`` of a dictionary (``role, value``): the injected ``translate(values) -> list`` gets batches of values,
    then at most ``rounds`` times those whose translation is missing, blank or an echo. What fails to the end stays null."""
    import pandas as pd

    from weftgraph.plans.materialize import materialize

    def run(batches):
        for b in batches:
            try:
                english = list(translate(b["value"].tolist()))
            except Exception:  # noqa: BLE001 - whatever the injected translator raises fails this batch, which is tried again
                english = [None] * len(b)
            yield pd.DataFrame({"role": b["role"], "value": b["value"], "value_en": english})

    done, left = None, words.select("role", "value")
    for turn in range(rounds + 1):
        found = materialize(left.mapInPandas(run, "role string, value string, value_en string"), "translated")
        bad = failed_translation(F.col("value"), F.col("value_en"))
        good = found.where(~bad)
        done = good if done is None else done.unionAll(good)
        left = found.where(bad).select("role", "value")
        if left.isEmpty():
            return done
    return done.unionAll(left.withColumn("value_en", F.lit(None).cast("string")))


def translate_chunks(triples: DataFrame, translate, by: list[str], roles: tuple[str, ...] = ("subject", "predicate", "object"), foreign: Column | None = None) -> DataFrame:
    """All triples with ``<role>_en``: those of chunks that ``foreign`` finds (all without it) through one dictionary of their distinct values."""
    own = triples
    if foreign is not None:
        own = triples.join(qualifying_chunks(triples, foreign, by).where("qualifies").select(by), by, "left_semi")
    words = own.unpivot(by, list(roles), "role", "value").where(F.trim("value") != "").select("role", "value").distinct()
    out = remap(own, translated(words, translate), list(roles))
    if foreign is None:
        return out
    rest = triples.join(own.select(by).distinct(), by, "left_anti")
    return out.unionByName(rest, allowMissingColumns=True)
