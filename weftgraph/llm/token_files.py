"""Token ids of documents in binary files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents. Each id takes the bits of the vocabulary's largest id, ``BLOCK_IDS``
ids make a block, and the offsets of the blocks and the places of the documents stand behind them; so any range
of ids is read by unpacking the blocks it touches (``IdFile.ids``), with array operations.

    header   8 bytes magic; little-endian int64: bits, ids a block, part, number in the part, ids of the part
             before the file, documents, ids, place of the block offsets
    blocks   packed ids, the lowest bits first
    offsets  int64 for each block and the end
    index    int64 document ids; a byte for each that says if it is null; int64 first id of each document and the end

Documents are dealt to parts by ranges of their id (nulls first, equals by a hash of the text, then by place in the
table), and each task writes its part as files of about ``FILE_IDS`` ids. A file appears under its name once it is
whole, a repeated task replaces it with the same bytes, and the manifest, which names all files with the number of ids
before each, is written last. The manifest's sums run over one row for each part.

Null texts are empty ones: they hold only the end id. Rows that repeat an id are documents of their own; an empty
table gives no files. Extra columns are not read. Memory: a batch of texts, a file's packed ids, a task's cache of words.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftgraph.plans.materialize import discard, materialize

from ._frame import by_rows, give_back
from ._pieces import encoded
from .bpe import byte_alphabet

MAGIC, HEADER, HEADER_BYTES = b"WEFTIDS1", "<8s8q", 72
BLOCK_IDS, FILE_IDS = 8192, 1 << 24
#: Ids that a reader unpacks at once, about, and bytes of words that a task keeps with their ids.
READ_IDS, CACHE_BYTES = 1 << 19, 48_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of each id, the lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a packed block, as little-endian unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class Encoder:
    """Encodes with the tokenizers library; where the file is plain byte-level BPE, its model gets each distinct word of a task once."""

    def __init__(self, file: bytes):
        self.library = Tokenizer.from_buffer(file)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(file)
        pre, special = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"]
        self.by_words = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special)
        self.special = {t["content"]: t["id"] for t in special}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _words(self, words: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known, tokenize, shown = self.known, self.library.model.tokenize, self.shown
        out = []
        for w in words:
            if (raw := known.get(w)) is None:
                found = self.special.get(w)
                ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(shown))] if found is None else [found]
                raw = known[w] = array("I", ids).tobytes()
                self.held += len(w) + len(raw) + 150
            out.append(raw)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and how many each has."""
        if not self.by_words:
            found = [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(found or [np.empty(0, dtype="<u4")]), np.array([len(x) for x in found], dtype=np.int64)
        return encoded(texts, self.special, self.between, self._words)


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


class _Part:
    """Writes the files of one part."""

    def __init__(self, folder: str, part: int, bits: int, file_ids: int):
        self.store, self.folder = _store(folder)
        self.part, self.bits, self.file_ids = part, bits, file_ids
        self.number = self.before = 0
        self._new()

    def _new(self) -> None:
        self.blocks: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.rest_ids = self.n_ids = 0
        self.docs: list[int | None] = []
        self.firsts = [0]

    def add(self, doc: int | None, ids: np.ndarray) -> dict | None:
        """Takes a document; what to tell about a file, when one is full."""
        self.docs.append(doc)
        self.n_ids += len(ids)
        self.firsts.append(self.n_ids)
        self.rest.append(ids)
        self.rest_ids += len(ids)
        if self.rest_ids >= 16 * BLOCK_IDS:
            self._blocks(False)
        return self.close() if self.n_ids >= self.file_ids else None

    def _blocks(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.rest or [np.empty(0, dtype="<u4")])
        upto = len(ids) if all_of_it else len(ids) - len(ids) % BLOCK_IDS
        self.blocks += [pack(ids[at : min(at + BLOCK_IDS, upto)], self.bits) for at in range(0, upto, BLOCK_IDS)]
        self.rest, self.rest_ids = [ids[upto:]], len(ids) - upto

    def close(self) -> dict | None:
        if not self.docs:
            return None
        self._blocks(True)
        offsets = np.cumsum([HEADER_BYTES, *map(len, self.blocks)], dtype="<i8")
        name = f"ids-{self.part:06d}-{self.number:06d}.bin"
        place, mine = f"{self.folder}/{name}", f"{self.folder}/.{name}.{os.getpid()}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with self.store.open_output_stream(mine) as out:
            out.write(struct.pack(HEADER, MAGIC, self.bits, BLOCK_IDS, self.part, self.number, self.before, len(self.docs), self.n_ids, int(offsets[-1])))
            for block in self.blocks:
                out.write(block)
            out.write(offsets.tobytes())
            out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
            out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
            out.write(np.array(self.firsts, dtype="<i8").tobytes())
        if self.store.type_name != "local" and self.store.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
            self.store.delete_file(place)
        self.store.move(mine, place)
        told = {"part": self.part, "number": self.number, "name": name, "n_docs": len(self.docs), "n_ids": self.n_ids, "before": self.before}
        self.before += self.n_ids
        self.number += 1
        self._new()
        return told


def write(df: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ids of every row to files below ``folder``, with ``end_id`` behind each document, and returns the manifest.

    ``path`` names a vocabulary file on the driver. The manifest, kept as Parquet in ``folder/manifest``, has
    ``name, part, number, n_docs, n_ids, start``: ``start`` counts the ids in all files before.
    """
    spark = df.sparkSession
    with open(path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    bits = max(1, max(max(Encoder(sent.value).library.get_vocab(with_added_tokens=True).values()), end_id).bit_length())
    _, inner = _store(folder)
    _store(folder)[0].create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = Encoder(sent.value), np.array([end_id], dtype="<u4")
        part = _Part(folder, TaskContext.get().partitionId(), bits, file_ids)
        told = []
        for b in by_rows(batches):
            flat, sizes = encoder.encode([x or "" for x in b.column(1).to_pylist()])
            at = 0
            for doc, n in zip(b.column(0).to_pylist(), sizes.tolist(), strict=True):
                told.append(part.add(doc, np.concatenate((flat[at : at + n], end))))
                at += n
        told = [x for x in (*told, part.close()) if x]
        del encoder, part
        give_back()
        yield pa.RecordBatch.from_pylist(told, schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("id"), "h", "place"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    files = materialize(dealt.select("id", "text").mapInArrow(run, "part long, number long, name string, n_docs long, n_ids long, before long"), "id-files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("base"))
    whole = files.join(parts, "part").select("name", "part", "number", "n_docs", "n_ids", (F.col("base") + F.col("before")).alias("start"))
    whole.write.parquet(f"{folder}/manifest")
    discard(files)
    return spark.read.parquet(f"{folder}/manifest")


class IdFile:
    """Random access to one file; ``reads`` counts the bytes of blocks that were read."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        magic, self.bits, self.block_ids, self.part, self.number, self.before, self.n_docs, self.n_ids, at = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
        if magic != MAGIC:
            raise ValueError(f"not a file of token ids: {path}")
        blocks, n = -(-self.n_ids // self.block_ids), self.n_docs
        raw = self.file.read_at(8 * (blocks + 1) + 17 * n + 8, at)
        self.offsets = np.frombuffer(raw, dtype="<i8", count=blocks + 1)
        self.docs = np.frombuffer(raw, dtype="<i8", count=n, offset=8 * (blocks + 1))
        self.nulls = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 * (blocks + 1) + 8 * n).astype(bool)
        self.firsts = np.frombuffer(raw, dtype="<i8", count=n + 1, offset=8 * (blocks + 1) + 9 * n)
        self.reads = 0

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the file's ``first`` on."""
        if count <= 0:
            return np.empty(0, dtype="<u4")
        a, b = first // self.block_ids, (first + count - 1) // self.block_ids
        begin, end = int(self.offsets[a]), int(self.offsets[b + 1])
        raw = self.file.read_at(end - begin, begin)
        self.reads += end - begin
        cuts = self.offsets[a : b + 2] - begin
        found = [unpack(raw[cuts[k] : cuts[k + 1]], self.bits, min(self.block_ids, self.n_ids - (a + k) * self.block_ids)) for k in range(b - a + 1)]
        return np.concatenate(found)[first - a * self.block_ids :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1] - self.firsts[k]))

    def close(self) -> None:
        self.file.close()


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids`` of every document in the files of a manifest.

    ``start`` counts the ids of all documents before; ``ids`` is binary, 4 bytes an id (unsigned, little-endian).
    """
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = IdFile(f"{folder}/{name}")
                at = 0
                while at < file.n_docs:
                    upto = max(at + 1, int(np.searchsorted(file.firsts, file.firsts[at] + READ_IDS, side="right")) - 1)
                    firsts = file.firsts[at : upto + 1]
                    raw = file.ids(int(firsts[0]), int(firsts[-1] - firsts[0])).tobytes()
                    cuts = ((firsts - firsts[0]) * 4).astype(np.int64)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), upto - at, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(file.docs[at:upto], mask=file.nulls[at:upto]), pa.array(start + firsts[:-1]), pa.array(np.diff(firsts)), ids], ["id", "start", "n_tokens", "ids"])
                    at = upto
                file.close()

    n = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("name", "start").repartition(n).mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
