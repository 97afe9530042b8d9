"""Token-ID binary output: bit-plane shuffled, zstandard-compressed id files with a chunk index.

File: ``GMTOKEN1``, chunks, document index, footer, footer length (u32), ``GMTOKEN1``. A chunk holds ``chunk_ids`` ids
(the last one fewer) as 1 to 4 byte planes, or 8 to 32 bit planes; each plane is a zstandard frame of its own. The footer (JSON) lists
each chunk's place, ids, plane sizes and crc32, so that any range of ids is read without the rest.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmason.llm.common import fresh_dir, stash

MAGIC = b"GMTOKEN1"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block, lowest first; as many as its largest id needs."""
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    if mode == "byte":
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(width)]
    return [np.packbits((rows[:, i] >> b) & 1, bitorder="little").tobytes() for i in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if mode == "byte":
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(p, np.uint8)
    else:
        for j, p in enumerate(planes):
            out[:, j // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (j % 8)
    return out.view("<u4").reshape(-1)


class Writer:
    """Streams documents into one file; holds one chunk and the document index."""

    def __init__(self, sink, chunk_ids: int = 1 << 16, mode: str = "bit", level: int = 3):
        self.sink, self.chunk_ids, self.mode = sink, chunk_ids, mode
        self.zip = zstandard.ZstdCompressor(level=level)
        self.chunks: list[dict] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents, how many ids each has, and all their ids in order."""
        self.docs.append(np.asarray(doc_ids, "<i8"))
        self.sizes.append(np.asarray(sizes, "<i8"))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.chunk_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % self.chunk_ids
        for i in range(0, end, self.chunk_ids):
            block = ids[i : min(i + self.chunk_ids, end)]
            planes = [self.zip.compress(p) for p in to_planes(block, self.mode)]
            self.chunks.append({"at": self.at, "n": len(block), "planes": [len(p) for p in planes], "crc32": zlib.crc32(block.astype("<u4").tobytes())})
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.held = [ids[end:]]
        self.n_held = len(ids) - end

    def close(self) -> None:
        self._flush(True)
        index = self.zip.compress(b"".join(np.concatenate(x or [np.zeros(0, "<i8")]).tobytes() for x in (self.docs, self.sizes)))
        foot = json.dumps({"mode": self.mode, "chunk_ids": self.chunk_ids, "ids": self.n_ids, "docs": sum(map(len, self.docs)), "index": [self.at, len(index)], "chunks": self.chunks}).encode()
        self.sink.write(index + foot + struct.pack("<I", len(foot)) + MAGIC)


class Reader:
    """Reads a seekable source: ``docs``, ``sizes`` and any range of ids."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 12)
        n, magic = struct.unpack("<I8s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut short")
        source.seek(end - 12 - n)
        self.foot = json.loads(source.read(n))
        source.seek(self.foot["index"][0])
        self.unzip = zstandard.ZstdDecompressor()
        index = np.frombuffer(self.unzip.decompress(source.read(self.foot["index"][1])), "<i8")
        self.docs, self.sizes = index[: self.foot["docs"]], index[self.foot["docs"] :]

    def chunk(self, k: int) -> np.ndarray:
        c = self.foot["chunks"][k]
        self.source.seek(c["at"])
        ids = from_planes([self.unzip.decompress(self.source.read(n)) for n in c["planes"]], c["n"], self.foot["mode"])
        if zlib.crc32(ids.tobytes()) != c["crc32"]:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids [start, start + n): only the chunks that hold them are read."""
        size = self.foot["chunk_ids"]
        found = [self.chunk(k) for k in range(start // size, min(len(self.foot["chunks"]), -(-(start + n) // size)))]
        return np.concatenate(found)[start % size : start % size + n] if found and n else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each document's id and ids, in file order; holds about a chunk and a document."""
        rest, k = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.docs.tolist(), self.sizes.tolist(), strict=True):
            if n > len(rest):
                more = [rest]
                have = len(rest)
                while have < n:
                    more.append(self.chunk(k))
                    have += len(more[-1])
                    k += 1
                rest = np.concatenate(more)
            yield doc, rest[:n]
            rest = rest[n:]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int | None = 2, chunk_ids: int = 1 << 16, mode: str = "bit") -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes files under ``out`` (default: a new folder in the shared one), ascending by
    doc_id over all files. Returns the manifest (path, first_doc, n_docs, n_ids), one row a file.

    Null text is empty text; a row with a null doc_id has no place in the order and is left out; repeated ids all stay, next
    to each other, ordered by text. A file is named after its task attempt and counts only once the manifest names it, so
    a task that runs again leaves no half-written result. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("doc_id is not null")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from gridmason.llm.tokens import bunches, encoder

        task, writer, enc, first = TaskContext.get(), None, encoder(tokenizer), None
        for doc_ids, texts in bunches(batches):
            doc_ids = doc_ids.to_numpy(zero_copy_only=False)
            if writer is None:
                first = int(doc_ids[0])
                fs, folder = _open(out)
                fs.create_dir(folder, recursive=True)
                path = f"{out}/{task.partitionId():06d}-{task.taskAttemptId()}.gmtok"
                sink = fs.open_output_stream(f"{folder}/{path.rsplit('/', 1)[1]}")
                writer = Writer(sink, chunk_ids, mode)
            ids, sizes = enc.ids(texts)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                sizes = sizes + 1
            writer.add(doc_ids, sizes, ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": [first], "n_docs": [sum(map(len, writer.docs))], "n_ids": [writer.n_ids]})

    return stash(rows.mapInArrow(write, "path string, first_doc long, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.
    The driver holds one row a file, never of documents."""
    files = sorted(manifest.collect(), key=lambda r: (r["first_doc"], r["path"]))
    starts = np.cumsum([0] + [r["n_ids"] for r in files])
    todo = spark.createDataFrame([(r["path"], int(s)) for r, s in zip(files, starts, strict=False)], "path string, base long").repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as f:
                    got: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                    held = 0
                    for doc, ids in Reader(f).documents():
                        for k, v in zip(got, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None), strict=False):
                            got[k].append(v)
                        at += len(ids)
                        held += len(ids) if with_ids else 1
                        if held >= 100_000:
                            yield pa.RecordBatch.from_pydict(got)
                            got, held = {k: [] for k in got}, 0
                    if got["doc_id"]:
                        yield pa.RecordBatch.from_pydict(got, schema=pa.schema([(k, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k in got]))

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
