"""Token-id files with shuffled bit or byte planes.

File layout, all numbers little-endian:

    "WPLN1\\n"                     magic
    plane ... plane                for each chunk of up to `block` ids its planes, each a zstandard frame;
                                   a plane of zeros takes no bytes
    documents                      zstandard frame: doc ids (int64), a null flag each (uint8), lengths (int64)
    footer                         JSON: dtype, mode, block, n_ids, n_docs, documents [offset, size],
                                   chunks [[offset, n_ids, [size of each plane]], ...]
    footer size (uint32) "WPLN1\\n"

The chunk index gives random access: ids a..b touch only the chunks that hold them.

Scale: documents are dealt into ranges of their id and a hash of their text,
sorted within a range, and each range becomes files that end at `file_ids`
ids, written to the shared folder under names of their own. Only files in the
manifest count, so lost or repeated tasks leave no trace. Where a file begins in
the whole sequence follows from sums over files, never over documents.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import materialise, small
from weftspark.llm.tokens import encoder

MAGIC = b"WPLN1\n"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of a block of uint32 ids: 4 of bytes, or 32 of bits, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, mode: str) -> np.ndarray:
    """The ids again; None stands for a plane of zeros."""
    if mode == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ids come in document by document, chunks leave as they fill."""

    def __init__(self, sink, *, mode: str, block: int, level: int):
        self.sink, self.mode, self.block = sink, mode, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_ids = self.at = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest).astype("<u4") if self.rest else np.empty(0, "<u4")
        cut = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, cut, self.block):
            part = ids[k : k + self.block]
            begin = self.at
            sizes = [self._put(self.pack.compress(p)) if any(p) else 0 for p in to_planes(part, self.mode)]
            self.chunks.append([begin, len(part), sizes])
        self.rest, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> int:
        self._flush(True)
        begin = self.at
        known = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        size = self._put(self.pack.compress(known.tobytes() + null.tobytes() + np.array(self.lengths, "<i8").tobytes()))
        footer = json.dumps({"dtype": "<u4", "mode": self.mode, "block": self.block, "n_ids": self.n_ids, "n_docs": len(self.lengths), "documents": [begin, size], "chunks": self.chunks}).encode()
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.sink.close()
        return self.at


class PlaneReader:
    """Reads a file through its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - len(MAGIC) - 4)
        tail = source.read(len(MAGIC) + 4)
        if tail[4:] != MAGIC:
            raise ValueError("not a plane file, or one that was not finished")
        n = struct.unpack("<I", tail[:4])[0]
        source.seek(size - len(tail) - n)
        self.meta = json.loads(source.read(n))
        self.unpack = zstandard.ZstdDecompressor()

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        at, size = self.meta["documents"]
        n = self.meta["n_docs"]
        self.source.seek(at)
        raw = self.unpack.decompress(self.source.read(size)) if n else b""
        known, null = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n : 9 * n], np.uint8)
        return [None if z else int(d) for d, z in zip(known, null, strict=True)], np.frombuffer(raw[9 * n :], "<i8")

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.meta["chunks"][k]
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        planes: list[bytes | None] = []
        begin = 0
        for s in sizes:
            planes.append(self.unpack.decompress(raw[begin : begin + s]) if s else None)
            begin += s
        return from_planes(planes, n, self.meta["mode"])

    def ids(self, first: int, end: int) -> np.ndarray:
        """ids first..end-1 of the file."""
        block = self.meta["block"]
        parts = []
        for k in range(first // block, -(-end // block) if end > first else first // block):
            part = self.chunk(k)
            parts.append(part[max(0, first - k * block) : end - k * block])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def stream(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, place of its first id in the file, its ids), a few chunks in memory at a time."""
        names, lengths = self.documents()
        have, k, place = np.empty(0, "<u4"), 0, 0
        for name, n in zip(names, lengths.tolist(), strict=True):
            parts, size = [have], len(have)
            while size < n:
                parts.append(self.chunk(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield name, place, have[:n]
            have = have[n:]
            place += n


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block: int = 1 << 16, file_ids: int = 1 << 25, file_docs: int = 1 << 20, level: int = 3, ranges: int | None = None) -> DataFrame:
    """Encode every text, write files under path in ascending id order; the manifest comes back.

    Manifest: path, part, seq, n_docs, n_ids, n_bytes, base (ids of all files
    before it). A null text has no ids but end_id; a null id sorts first; rows of
    equal id stay side by side, in the order of a hash of their texts, so that an id
    of many rows (or no id) is dealt to many ranges. A file ends at file_ids ids or file_docs
    documents; a very long text is one document of one file. Other columns are
    ignored. An empty table gives an empty manifest.
    """
    if mode not in ("bit", "byte"):
        raise ValueError("mode is bit or byte")
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # one pass follows the deal, so the number of a range can be that of its partition
    by = [F.asc_nulls_first("id"), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by, "text").withColumn("part", F.spark_partition_id())
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_file)
        fs, root = pa.fs.FileSystem.from_uri(path)
        writer, now, name = None, None, ""
        done: list[tuple] = []

        def finish() -> None:
            size = writer.close()
            done.append((name, now[0], now[1], len(writer.lengths), writer.n_ids, size))

        for batch in small(batches):
            for doc_id, text, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if writer is None or now[0] != k or writer.n_ids >= file_ids or len(writer.lengths) >= file_docs:
                    if writer is not None:
                        finish()
                    now = (k, now[1] + 1 if now and now[0] == k else 0)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{k:06d}-{now[1]:05d}-{uuid.uuid4().hex[:8]}.wpln"
                    writer = PlaneWriter(fs.open_output_stream(f"{root}/{name}"), mode=mode, block=block, level=level)
                writer.add(doc_id, np.concatenate([words.ids(text).astype("<u4"), tail]))
        if writer is not None:
            finish()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["file", "part", "seq", "n_docs", "n_ids", "n_bytes"])

    files = materialise(dealt.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long, n_bytes long"), "manifest")
    return _with_base(files).select(F.concat(F.lit(path + "/"), "file").alias("path"), "part", "seq", "n_docs", "n_ids", "n_bytes", "base")


def _with_base(files: DataFrame) -> DataFrame:
    """Adds base, the ids of all files before: sums of the parts (one number for each), then within a part."""
    from pyspark.sql import Window

    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "part long, start long")
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(F.broadcast(starts), "part").withColumn("base", F.col("start") + inner).drop("start")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) for every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in small(batches):
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as source:
                    rows, size = [], 0
                    for doc_id, at, ids in PlaneReader(source).stream():
                        rows.append((doc_id, base + at, len(ids), ids.tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
