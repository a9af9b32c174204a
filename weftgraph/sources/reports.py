"""Writers: analysis documents, chunk folders, triple envelopes and query reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import chunking

#: The lines of an analysis document and of a report.
TITLE, OPEN, CLOSE, RULE = "# Document Analysis: ", "<start>\n", "</end>\n", "---\n"
CUT, LEFT_OUT = "\n\n*[Content truncated for length]*", "\n*[Remaining files omitted — size limit reached]*\n"


def analysis(pages: DataFrame, by: str, name: Column, kind: Column, model: Column, page: str = "page", text: str = "text") -> DataFrame:
    """``by, markdown``: a head and, between flags, each page's text below the one before."""
    one = F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    grouped = pages.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("_p"), F.min(name).alias("_n"), F.min(kind).alias("_k"), F.min(model).alias("_m"))
    unknown = F.lit("unknown")
    head = [
        F.concat(F.lit(TITLE), "_n", F.lit("\n")), F.concat(F.lit("**File Type:** "), F.coalesce("_k", unknown), F.lit("\n")),
        F.concat(F.lit("**Total Pages:** "), F.size("_p").cast("string"), F.lit("\n")), F.concat(F.lit("**Processing Model:** "), F.coalesce("_m", unknown), F.lit("\n")), F.lit(RULE), F.lit(OPEN),
    ]
    body = F.array_join(F.transform("_p", lambda s: F.concat(F.when(s["t"] != "", F.concat(s["t"], F.lit("\n\n"))).otherwise(""), F.lit(RULE))), "\n")
    return grouped.select(by, F.concat_ws("\n", *head, body, F.lit(CLOSE)).alias("markdown"))


def write_chunks(chunks: DataFrame, path: str, by: str = "community_id") -> DataFrame:
    """Chunks as Parquet, a folder for each community, and beside them the manifest's statistics, which it returns."""
    chunks.write.mode("overwrite").partitionBy(by).parquet(f"{path}/chunks")
    spark = chunks.sparkSession
    chunking.statistics(spark.read.parquet(f"{path}/chunks"), by).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def envelopes(triples: DataFrame, by: str, chunk: str = "chunk_id") -> DataFrame:
    """``by, total_chunks, total_triples, largest_chunk``: partial counts for each chunk first, so a hot document is no hot task."""
    counted = triples.groupBy(by, chunk).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.count("*").alias("total_chunks"), F.sum("n").alias("total_triples"), F.max("n").alias("largest_chunk"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples by chunk; writing again replaces the chunks that ``triples`` has and leaves the others."""
    triples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)


def report(results: DataFrame, title: str, query: str) -> DataFrame:
    """``pos, line``: a result table as a report, rows from 1 in their ``pos``; the text stays distributed."""
    fields = [c for c in results.columns if c != "pos"]
    rows = results.select("pos", F.concat(F.lit("### Result "), F.col("pos").cast("string"), F.lit("\n\n```json\n"), F.to_json(F.struct(*fields)), F.lit("\n```\n")).alias("line"))
    count = results.agg(F.count("*").alias("n"))
    head = count.select(F.lit(0).cast("long").alias("pos"), F.concat(F.lit(f"# Query Results: {title}\n\n## Query\n\n```\n{query}\n```\n\n## Results ("), F.col("n").cast("string"), F.lit(" records)\n"), F.when(F.col("n") == 0, "\n*No results found*\n").otherwise("")).alias("line"))
    return head.unionAll(rows.withColumn("pos", F.col("pos").cast("long")))


def listed(spark: SparkSession, folder: str, suffix: str = "*.md") -> DataFrame:
    """``path, size, modified`` of the reports in a folder, the newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def results_in(spark: SparkSession, folder: str, suffix: str = "*.md") -> DataFrame:
    """``path, result_no, json``: the results of all reports in a folder, back from their fenced blocks; what is no JSON is left out.

    Files are cut at the headings of results, so a large report is read by many tasks.
    """
    records = spark.read.option("lineSep", "\n### Result ").option("pathGlobFilter", suffix).text(folder)
    block = r"^(?:### Result )?(\d+)\s*\n```json\s*\n(?s:(.*?))\n```"
    found = records.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", block, 1).alias("no"), F.regexp_extract("value", block, 2).alias("json"))
    return found.where(F.try_parse_json("json").isNotNull()).select("path", F.col("no").try_cast("long").alias("result_no"), "json")


def read_reports(spark: SparkSession, folder: str, each: int = 8000, total: int = 40000, files: int = 10) -> str:
    """The newest reports, each and all together cut to so many characters."""
    newest = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).orderBy(F.desc("modificationTime"), "path").limit(files)
    out, used = [], 0
    for row in newest.select("path", F.substring(F.decode("content", "UTF-8"), 1, each + 1).alias("t")).collect():  # at most ``files`` rows of ``each`` characters
        if used >= total:
            out.append(LEFT_OUT)
            break
        text = row.t if len(row.t) <= each else row.t[:each] + CUT
        text = text if len(text) <= total - used else text[: total - used] + CUT
        out.append(f"\n---\n## File: {row.path.rpartition('/')[2]}\n---\n" + text)
        used += len(out[-1])
    return "\n".join(out)
