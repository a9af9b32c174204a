"""Office files, images, chunk folders and triple files as rows."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import file_type, truncated

#: Image suffixes that are passed on.
ENCODED = (".png", ".jpg", ".jpeg", ".webp")
PAGES = "path string, kind string, page int, text string, error string"
TRIPLES = "source_file string, total_chunks bigint, total_triples bigint, chunks array<struct<chunk_id: bigint, triples: array<struct<subject: string, predicate: string, object: string, evidence_quote: string>>>>"
MANIFEST = "total_chunks bigint, chunks array<struct<chunk_id: bigint, start_line: bigint, end_line: bigint, file: string, size: bigint, content: string>>"


def _own(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part's relations name, by relation id."""
    folder, name = posixpath.split(part)
    root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, t)).lstrip("/") if not (t := r.get("Target", "")).startswith("/") else t[1:] for r in root}


def _listed(z: zipfile.ZipFile, part: str, item: str) -> list[str]:
    """The parts that stand behind the ``item`` elements of a part, in its order."""
    to = _targets(z, part)
    found = [next((v for k, v in e.attrib.items() if k.endswith("}id")), "") for e in ElementTree.fromstring(z.read(part)).iter() if _own(e) == item]
    return [to[i] for i in found if i in to]


def _runs(e: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _own(x) == "t" else marks.get(_own(x), "") for x in e.iter())


def docx_pages(z: zipfile.ZipFile) -> list[str]:
    """One page for each paragraph of the body that is not blank."""
    body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _own(e) == "body")
    return [t for t in (_runs(p) for p in body if _own(p) == "p") if t.strip()]


def pptx_pages(z: zipfile.ZipFile) -> list[str]:
    """One page for each slide: the texts of its shapes, one a line; ``Slide n`` for an empty one."""
    out = []
    for n, part in enumerate(_listed(z, "ppt/presentation.xml", "sldId"), 1):
        bodies = (e for e in ElementTree.fromstring(z.read(part)).iter() if _own(e) == "txBody")
        text = "\n".join("\n".join(_runs(p) for p in b if _own(p) == "p") for b in bodies)
        out.append(text if text.strip() else f"Slide {n}")
    return out


def _number(text: str) -> str:
    try:
        return str(int(text))
    except ValueError:
        return repr(float(text))


def xlsx_pages(z: zipfile.ZipFile) -> list[str]:
    """One page for each sheet: its rows that hold a value, cells parted by tabs; ``Sheet n`` for an empty one.

    Dates keep the number they are stored as.
    """
    shared = [_runs(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _own(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for n, part in enumerate(_listed(z, "xl/workbook.xml", "sheet"), 1):
        rows: list[dict[int, str]] = []
        for row in (e for e in ElementTree.fromstring(z.read(part)).iter() if _own(e) == "row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(e for e in row if _own(e) == "c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.upper()))) - 1 if letters else at
                value, kind = next((e.text for e in c if _own(e) == "v"), None), c.get("t", "n")
                if kind == "inlineStr":
                    value = _runs(c)
                elif value is not None:
                    value = {"s": lambda v: shared[int(v)], "b": lambda v: str(v == "1"), "n": _number}.get(kind, str)(value)
                if value is not None:
                    cells[column] = value
            if cells:
                rows.append(cells)
        width = max((max(r) + 1 for r in rows), default=0)
        out.append("\n".join("\t".join(r.get(i, "") for i in range(width)) for r in rows) or f"Sheet {n}")
    return out


READERS: dict[str, Callable[[zipfile.ZipFile], list[str]]] = {"docx": docx_pages, "pptx": pptx_pages, "xlsx": xlsx_pages}


def office_pages(files: DataFrame) -> DataFrame:
    """``path, kind, page, text, error`` of the docx, pptx and xlsx files among ``path, content``.

    A file is the largest thing a task holds. One that cannot be read is one row with its ``error`` and page 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, raw in zip(*(b.column(i) for i in range(3)), strict=True):
                path, kind = path.as_py(), kind.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py() or b"")) as z:
                        rows = [(path, kind, n, t, None) for n, t in enumerate(READERS[kind](z), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, IndexError) as e:
                    rows = [(path, kind, 0, None, f"{type(e).__name__}: {e}")]
                types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "kind", "page", "text", "error"])

    own = files.select("path", file_type(F.col("path")).alias("kind"), "content").where(F.col("kind").isin(*READERS))
    return own.mapInArrow(run, PAGES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all files below a folder of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def images(files: DataFrame) -> DataFrame:
    """``path, page, image``: the files with a known image suffix, in base64."""
    known = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(*ENCODED)
    return files.where(known).select("path", F.lit(1).alias("page"), F.base64("content").alias("image"))


def chosen_pages(pages: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Only the wanted pages; an error if a document has fewer."""
    if not wanted:
        return pages
    most = pages.groupBy("path").agg(F.max("page").alias("_most"))
    fits = F.when(F.col("_most") >= max(wanted), F.col("page")).otherwise(F.raise_error(F.concat(F.lit(f"no page {max(wanted)} in "), "path")).cast("int"))
    return pages.join(most, "path").withColumn("page", fits).where(F.col("page").isin(*wanted)).drop("_most")


def labelled_text(pages: DataFrame, by: str, page: str = "page", text: str = "text") -> DataFrame:
    """``by, text``: the pages in order, each below a line with its number."""
    one = F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    shown = F.transform(F.sort_array(F.collect_list(one)), lambda s: F.concat(F.lit("--- Page "), s["p"].cast("string"), F.lit(" ---\n"), s["t"]))
    return pages.groupBy(by).agg(F.array_join(shown, "\n\n").alias("text"))


def manifest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """``chunk_id, content`` of a chunk folder: by its ``manifest.json``, whose entries name files or hold the content."""
    listed = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{folder}/manifest.json").select(F.explode("chunks").alias("c")).select("c.*")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"), F.col("value").alias("_text"))
    out = listed.join(files, listed["file"] == files["_file"], "left")
    return out.select("chunk_id", F.coalesce("content", "_text", F.lit("")).alias("content"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, chunk_id, triple_no, subject, predicate, object, evidence_quote`` of JSON triple files."""
    chunks = spark.read.schema(TRIPLES).option("multiLine", "true").json(path).select("source_file", F.explode("chunks").alias("c"))
    return chunks.select("source_file", "c.chunk_id", F.posexplode("c.triples").alias("triple_no", "t")).select("source_file", "chunk_id", "triple_no", "t.*")


def chunk_texts(refs: DataFrame, chunks: DataFrame, most: int = 4000) -> DataFrame:
    """The texts of distinct ``community_id, chunk_id``, cut at ``most`` characters; ``error`` where there is none."""
    out = refs.select("community_id", "chunk_id").distinct().join(chunks.select("community_id", "chunk_id", F.col("content").alias("_c")), ["community_id", "chunk_id"], "left")
    return out.select("community_id", "chunk_id", truncated(F.col("_c"), most).alias("text"), F.when(F.col("_c").isNull(), "not found").alias("error"))


def greatest_chunk(names: DataFrame, name: Column, by: str = "community_id") -> DataFrame:
    """``by, chunk_id``: the greatest number in names like ``chunk_012.txt``, 0 without one."""
    number = F.regexp_extract(name, r"chunk_(\d+)\.txt$", 1)
    return names.groupBy(by).agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0).cast("long")).alias("chunk_id"))
