"""Documents into lines and chunks, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import strip


#: White space that a wrapped line has as spaces.
SPACES = str.maketrans("\x0b\x0c\r", "   ")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, line_no int`` (from 0) and ``text``."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))


def _folded(line: str, width: int) -> list[str]:
    """A line as lines of at most ``width`` characters.

    Tabs reach to the next column that is a multiple of eight, other white space is a space. Continued lines have the line's
    own indent. Gaps at a break go; a longer word stands alone; a line of white space vanishes.
    """
    indent = " " * (len(line) - len(line.lstrip(" \t\n\x0b\x0c\r")))
    done: list[str] = []
    now, lead = "", ""
    for token in re.findall(" +|[^ ]+", line.expandtabs(8).translate(SPACES)):
        if now:
            if len(now) + len(token) + len(lead) <= width:
                now += token
                continue
            if kept := now.rstrip(" "):
                done.append(lead + kept)
                lead = indent
            now = ""
        gap = token[0] == " "
        if gap and done:
            continue
        if len(token) + len(lead) <= width:
            now = token
        elif not gap:
            done.append(lead + token)
            lead = indent
    if kept := now.rstrip(" "):
        done.append(lead + kept)
    return done


def wrapped_lines(docs: DataFrame, width: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lines_of``, with lines of more than ``width`` characters wrapped at white space; a document's lines stay in its row, so none are shuffled."""

    @F.udf("array<string>", useArrow=True)
    def wrapped(text: str | None) -> list[str] | None:
        if text is None:
            return None
        return [part for line in text.split("\n") for part in ([line] if len(line) <= width else _folded(line, width))]

    return docs.select(id_col, F.posexplode(wrapped(text_col)).alias("line_no", "text"))


def header_chunks(lines: DataFrame, is_header: Column, id_col: str = "doc_id") -> DataFrame:
    """A chunk begins at each header: ``id_col, chunk_id, content, start_line, end_line`` (lines from 1).

    Gaps and islands over each document's lines; chunks without text go, ids are consecutive.
    """
    w = Window.partitionBy(id_col).orderBy("line_no")
    marked = lines.withColumn("island", F.sum(is_header.cast("int")).over(w))
    parts = marked.groupBy(id_col, "island").agg(
        strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n")).alias("content"),
        (F.min("line_no") + 1).alias("start_line"),
        (F.max("line_no") + 1).alias("end_line"),
    )
    full = parts.where(F.col("content") != "")
    return full.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("island")).alias("chunk_id"), "content", "start_line", "end_line")


def range_chunks(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Content of line ranges (from 1, inclusive): one join on the document, then slices of its lines."""
    cut = docs.select(id_col, F.split(text_col, "\n").alias("_lines")).join(ranges, id_col)
    content = strip(F.array_join(F.slice("_lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n"))
    return cut.select(id_col, "chunk_id", content.alias("content"), F.col("start").alias("start_line"), F.col("end").alias("end_line")).where(F.col("content") != "")


def sections(docs: DataFrame, size: int = 1000, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sliding sections of a document's lines: starts ``size - overlap`` apart; a tail may repeat the overlap."""
    n = F.size(F.split(text_col, "\n"))
    step = max(size - overlap, 1)
    return docs.select(id_col, n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(step))).alias("start")).select(id_col, "start", F.least("n", F.col("start") + size - 1).alias("end"))


def statistics(chunks: DataFrame, by: str) -> DataFrame:
    size = F.length("content")
    return chunks.groupBy(by).agg(F.count("*").alias("total_chunks"), F.sum(size).alias("total_characters"), F.round(F.avg(size), 2).alias("average_chunk_size"), F.min(size).alias("min_chunk_size"), F.max(size).alias("max_chunk_size"))


def continue_ids(chunks: DataFrame, existing: DataFrame, community: str = "community_id") -> DataFrame:
    """New chunks numbered on from their community's greatest id."""
    most = existing.groupBy(community).agg(F.max("chunk_id").alias("_most"))
    w = Window.partitionBy(community).orderBy("chunk_id")
    out = chunks.join(most, community, "left")
    return out.withColumn("chunk_id", (F.coalesce("_most", F.lit(0)) + F.row_number().over(w)).cast("long")).drop("_most")


def surrounding(chunks: DataFrame, anchors: DataFrame, window: int = 2, by: str = "community_id") -> DataFrame:
    """Chunks within ``window`` ids of an anchor: the range is unrolled, so the join has equal keys."""
    wanted = anchors.select(by, F.col("chunk_id").alias("anchor"), F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("chunk_id") - window), F.col("chunk_id") + window)).alias("chunk_id"))
    return wanted.join(chunks, [by, "chunk_id"])


def section_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 1000, least: int = 100, context: int = 1000, most: int = 50_000, overlap: int = 50) -> DataFrame:
    """``id_col, size``: how many lines a section of each document takes.

    The candidates fall from ``first`` (or all lines) by a fifth each; the greatest above ``least`` whose text of that many lines and
    ``context`` stay within ``most`` tokens of four characters counts, with the overlap; without one it is ``least``.
    """
    text = F.col(text_col)
    n = F.length(F.regexp_replace(text, "[^\n]", "")) + 1
    rounds = 1
    while first * 0.8**rounds > least:
        rounds += 1
    falling = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(F.least(n, F.lit(first))), lambda found, _: F.concat(found, F.array((F.element_at(found, -1) * F.lit(0.8)).cast("int"))))
    tokens = lambda lines: F.floor(F.length(F.call_function("substring_index", text, F.lit("\n"), lines)) / 4)
    fits = F.filter(falling, lambda size: (size > least) & (tokens(size) + context <= most))
    best = F.get(fits, F.lit(0))
    size = F.when(best.isNull(), least).otherwise(F.least(best + overlap, n))
    return docs.where(text.isNotNull()).select(id_col, size.cast("int").alias("size"))


def absolute_ranges(ranges: DataFrame) -> DataFrame:
    """A section's ranges (``section_start, start, end``, counted within it) as lines of the document."""
    shift = F.col("section_start") - 1
    return ranges.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift})


def chunked(docs: DataFrame, answer, id_col: str = "doc_id", text_col: str = "text", tries: int = 3) -> DataFrame:
    """``id_col, chunk_id, content, start_line, end_line``: chunks where the injected ``answer(numbered text)`` puts them.

    It returns ``(start, end)`` pairs; after ``tries`` failures, or where it gives none, headers begin chunks. A blank document is an error.
    """

    @F.udf("array<struct<start: bigint, end: bigint>>", useArrow=True)
    def asked(text: str) -> list[tuple[int, int]]:
        if not text.strip():
            raise ValueError("a document without text")
        for _ in range(tries):
            try:
                return [tuple(map(int, x)) for x in answer("\n".join(f"[{k:04d}] {x}" for k, x in enumerate(text.split("\n"), 1)))]
            except Exception:  # noqa: BLE001 - whatever the injected model raises is tried again
                continue
        return []

    from weftgraph.functions.model_output import chunk_ranges
    from weftgraph.plans.materialize import materialize

    rows = materialize(docs.select(id_col, text_col, asked(text_col).alias("_a")), "answers")  # the model is asked once
    rows = rows.select(id_col, text_col, chunk_ranges(F.col("_a"), F.size(F.split(text_col, "\n")).cast("long")).alias("_r"))
    found = rows.where(F.size("_r") > 0)
    part = lambda lines, r: strip(F.array_join(F.slice(lines, r["start"].cast("int"), (r["end"] - r["start"] + 1).cast("int")), "\n"))
    cut = lambda lines: F.transform("_r", lambda r: F.struct(r["id"].cast("int").alias("chunk_id"), part(lines, r).alias("content"), r["start"].alias("start_line"), r["end"].alias("end_line")))
    own = found.select(id_col, F.inline(F.flatten(F.transform(F.array(F.split(text_col, "\n")), cut)))).where(F.col("content") != "")  # a row's ranges cut its own lines, split once
    plain = header_chunks(lines_of(rows.where(F.size("_r") == 0), id_col, text_col), F.col("text").startswith("#"), id_col)
    return own.select(plain.columns).unionAll(plain)
