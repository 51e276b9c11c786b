"""Token ids in seekable zstandard files.

One shard is a row of independent zstandard frames, one per document, with content checksums; then
a skippable frame with the documents' ids; then the seek table of the public zstandard seekable
format (a skippable frame: sizes and checksum of every frame, then a footer), so a reader finds a
document from the end of the file and decompresses nothing else.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import END_ID, file_system, settle, shared_dir
from earshot.llm.encoder import encoder, units

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
FOOTER = 0x8F92EAB1
DIRECTORY = 0x184D2A50
NO_ID = -(1 << 63)


class ShardWriter:
    """Writes frames one after the other; ``close`` adds the directory and the seek table."""

    def __init__(self, sink):
        import zstandard

        self.sink = sink
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.entries: list[bytes] = []
        self.ids: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.zip.compress(ids)
        self.sink.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        names = struct.pack(f"<{len(self.ids)}q", *self.ids)
        self.sink.write(struct.pack("<II", DIRECTORY, len(names)) + names)
        seek = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class ShardReader:
    """Reads the directory from the file's end, then single frames by number."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        at = end - 9 - 12 * n - 8
        table = np.frombuffer(self._at(at + 8, 12 * n), dtype="<u4").reshape(n, 3)
        self.sizes, self.raw, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.starts = (np.cumsum(self.raw) - self.raw) // 4
        self.ids = np.frombuffer(self._at(at - 8 * n, 8 * n), dtype="<i8")

    def _at(self, place: int, size: int) -> bytes:
        return self.source.read_at(size, place)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.unzip.decompress(self._at(int(self.places[k]), int(self.sizes[k])))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes ``doc_id, text`` and writes shards in ascending doc_id order.

    Null and empty texts are the end id alone. Rows with one doc_id all stay, next to each other;
    null ids come first. Other columns are not used. Returns the manifest: shard, path, n_docs,
    n_tokens, first_id, last_id, start (tokens of all shards before). A shard's name holds a
    random part and only the manifest names it, so what a lost task left behind is never read.
    Runs the job.
    """
    out = out or shared_dir(docs.sparkSession, "tokens")
    tail = struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        files, folder = file_system(out)
        files.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
        enc, sink, writer = encoder(tokenizer), None, None
        for b in batches:
            for lo, hi in units(b.column(1)):
                some = b.slice(lo, hi - lo)
                for i, raw in zip(some.column(0).to_pylist(), enc.encode_column(some.column(1)), strict=True):
                    if writer is None:
                        sink = files.open_output_stream(f"{folder}/{path}", compression=None)
                        writer = ShardWriter(sink)
                    writer.add(i, raw.as_py() + tail)
        if writer is not None:
            writer.close()
            sink.close()
            real = [i for i in writer.ids if i != NO_ID]
            yield pa.RecordBatch.from_pylist([
                {"shard": shard, "path": f"{out}/{path}", "n_docs": len(writer.ids), "n_tokens": writer.tokens,
                 "first_id": min(real, default=None), "last_id": max(real, default=None)}
            ], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()),
                                 ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    manifest = settle(
        rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, first_id long, last_id long"),
        "token-manifest",
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids (binary). With ``doc_ids`` only their frames are read."""
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def read(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for row in b.to_pylist():
                files, _ = file_system(row["path"])
                with files.open_input_file(file_system(row["path"])[1]) as source:
                    shard = ShardReader(source)
                    frames = range(len(shard.ids)) if wanted is None else np.flatnonzero(np.isin(shard.ids, wanted))
                    out, size = [], 0
                    for k in frames:
                        raw, i = shard.frame(int(k)), int(shard.ids[k])
                        out.append((None if i == NO_ID else i, row["start"] + int(shard.starts[k]), len(raw) // 4, raw))
                        size += len(raw)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    if wanted is not None:
        near = F.lit(False)
        if wanted:
            near = (F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1])
        manifest = manifest.filter(near)
    shards = manifest.select("path", "start")
    n = max(1, manifest.count())
    return shards.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
