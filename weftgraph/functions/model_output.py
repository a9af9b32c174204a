"""Parsing of model answers: extraction and repair of JSON, ranges, decisions, translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "struct<chunks: array<struct<id: bigint, start: bigint, end: bigint>>>"
DECISIONS = "array<struct<id: bigint, same: boolean, canon: string>>"


def json_part(text: Column) -> Column:
    """The fenced JSON object, or what stands between the first ``{`` and the last ``}``; null if blank."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    open_at, close_at = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    outer = F.when((open_at > 0) & (F.instr(text, "}") > 0) & (close_at > open_at), F.substring(text, open_at, close_at - open_at + 1))
    return F.when(F.trim(text) == "", None).when(fenced != "", fenced).otherwise(outer)


def repaired(text: Column) -> Column:
    """Doubled braces, trailing commas, single quotes, bare keys and inner line breaks put right, in this order; the patterns are fixed values."""
    out = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    out = F.regexp_replace(out, r",\s*([}\]])", "$1")
    out = F.regexp_replace(out, r"""(?<![\\"'])'([^']*)'(?![\\"'])""", '"$1"')
    out = F.regexp_replace(out, r'(?<!")(\b\w+\b)\s*:', '"$1":')
    return F.regexp_replace(out, r"(?<=\S)\n(?=\S)", " ")


def parsed(text: Column, schema: str) -> Column:
    """The object in a text as it is, else after repair, else null."""
    found = json_part(text)
    read = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    return F.coalesce(read(found), read(repaired(found)))


def chunk_ranges(ranges: Column, lines: Column) -> Column:
    """Ranges with 1 <= start <= end and start <= lines; cut, sorted, gaps closed by the one before, numbered."""
    good = F.filter(ranges, lambda r: (r["start"] >= 1) & (r["end"] >= r["start"]) & (r["start"] <= lines))
    cut = F.array_sort(F.transform(good, lambda r: F.struct(r["start"].cast("long").alias("start"), F.least(r["end"], lines).cast("long").alias("end"))))
    first = F.get(cut, F.lit(0))["start"]
    lead = F.when(first > 1, F.array(F.struct(F.lit(1).cast("long").alias("start"), (first - 1).cast("long").alias("end")))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
    whole = F.concat(lead, cut)
    closed = lambda r, i: F.struct((i + 1).alias("id"), r["start"].alias("start"), F.coalesce(F.greatest(r["end"], F.get(whole, i + 1)["start"] - 1), r["end"]).alias("end"))
    return F.transform(whole, closed)


def split_ranges(points: Column, lines: Column) -> Column:
    """Ranges between split points; the first begins at 1, the last ends at the last line."""
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), F.filter(points, lambda p: (p >= 1) & (p <= lines)))))
    return F.transform(starts, lambda s, i: F.struct((i + 1).alias("id"), s.alias("start"), F.coalesce(F.get(starts, i + 1) - 1, lines).alias("end")))


def merged_small(ranges: Column, least: int = 3) -> Column:
    """A range that begins less than ``least`` lines after the last kept one extends that one."""
    kind = "array<struct<start: bigint, end: bigint>>"

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(r["start"].cast("long").alias("start"), r["end"].cast("long").alias("end"))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), r["end"].cast("long").alias("end"))))
        return F.when(F.size(acc) == 0, F.array(one)).when(r["start"] - F.get(acc, F.size(acc) - 1)["start"] >= least, F.concat(acc, F.array(one))).otherwise(longer)

    return F.aggregate(ranges, F.array().cast(kind), step)


def decisions(text: Column) -> Column:
    """A decision list: bare, fenced, or between the first ``[`` and the last ``]``; else empty."""
    found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(found, DECISIONS), F.array().cast(DECISIONS))


def first_object(text: Column) -> Column:
    """The first JSON object whose braces balance outside of strings; null without one. Braces cannot be balanced by a pattern."""

    @F.udf("string", useArrow=True)
    def find(value: str | None) -> str | None:
        start = (value or "").find("{")
        while start >= 0:
            depth, quoted, skip = 0, False, False
            for at in range(start, len(value)):
                c = value[at]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        return value[start : at + 1]
            start = value.find("{", start + 1)
        return None

    return find(text)


TRIPLES = "struct<discovered_triples: array<struct<subject: string, predicate: string, object: string, evidence_lines: struct<start: string, end: string>>>>"
#: Patterns of answers that hold nothing.
GARBAGE = (r"_PROCESSING_", r"_SUPPRESSED_", r"DISPLAY\}", r"^\s*\{[\s_A-Z]+\}")


def triple_answer(text: Column) -> Column:
    """The triples of an answer, empty for garbage and what cannot be read; evidence lines begin at 1 at least and end not
    before they begin, and are null where they are no whole numbers."""
    nothing = F.array().cast("array<struct<subject: string, predicate: string, object: string, start: bigint, end: bigint>>")
    garbage = F.coalesce(F.trim(text) == "", F.lit(True))
    for pattern in GARBAGE:
        garbage = garbage | F.trim(text).rlike(pattern)
    whole = lambda c: F.when(c.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(c).cast("long"))

    def one(t: Column) -> Column:
        a, z = whole(t["evidence_lines"]["start"]), whole(t["evidence_lines"]["end"])
        start = F.when(z.isNotNull(), F.greatest(a, F.lit(1).cast("long")))
        start = F.when(a.isNotNull(), start)
        return F.struct(t["subject"].alias("subject"), t["predicate"].alias("predicate"), t["object"].alias("object"), start.alias("start"), F.when(start.isNotNull(), F.greatest(start, z)).alias("end"))

    found = parsed(text, TRIPLES)["discovered_triples"]
    return F.when(garbage, nothing).otherwise(F.coalesce(F.transform(found, one), nothing))


def ranges_by_pattern(text: Column) -> Column:
    """``start, end`` pairs found in an answer that cannot be parsed."""
    found = F.regexp_extract_all(text, F.lit(r'(?s)("start"\s*:\s*\d+\s*,\s*"end"\s*:\s*\d+)'), 1)
    number = lambda x, k: F.get(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), F.lit(k)).cast("long")
    return F.transform(found, lambda x: F.struct(number(x, 0).alias("start"), number(x, 1).alias("end")))


def numbers_in_list(text: Column) -> Column:
    """The numbers of the first bare list of numbers: split points of an older kind of answer."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(text, r"\[([\d\s,]+)\]", 1), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def listed_decisions(text: Column) -> Column:
    """``decisions``, where a list that is a value of an object counts too; empty without any."""
    return decisions(F.regexp_extract(text, r"(?s)(\[.*\])", 1))


TRANSLATIONS = "array<struct<id: bigint, value_en: string>>"


def translations(text: Column) -> Column:
    """Translations of an answer: fences go, bare words in capitals become strings, a single object is a list of one; else empty."""
    plain = F.regexp_replace(text, r"```(?:json)?", "")
    body = F.coalesce(F.nullif(F.regexp_extract(plain, r"(?s)(\[.*\])", 1), F.lit("")), F.concat(F.lit("["), F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit("")), F.lit("]")))
    quoted = F.regexp_replace(body, r":\s*([A-Z][A-Z0-9_]*)\s*([,}])", ': "$1"$2')
    found = F.coalesce(F.from_json(body, TRANSLATIONS), F.from_json(quoted, TRANSLATIONS))
    kept = F.filter(found, lambda t: t.isNotNull() & (t["id"].isNotNull() | t["value_en"].isNotNull()))
    return F.coalesce(F.when(F.size(kept) > 0, kept), F.from_json(quoted, TRANSLATIONS), F.array().cast(TRANSLATIONS))


def resolution(same: Column, canon: Column) -> Column:
    """``new``, ``alias`` or ``replace`` by a decision; an undecided pair is new."""
    return F.when(~F.coalesce(same, F.lit(False)), "new").when(F.upper(canon) == "B", "replace").otherwise("alias")
