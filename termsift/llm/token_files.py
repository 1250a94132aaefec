"""Token ids in binary files, each document compressed apart with one shared dictionary.

A folder holds ``dictionary.zstd`` (trained on the serialized ids of a bounded sample: a run of each
of some documents) and one ``shard-NNNNN.tok`` per range of documents, in ascending doc_id order:

    magic | sha256 of the dictionary | frames | index | length of the index | magic

A frame is the zstandard form of a document's little-endian unsigned 16-bit ids. The index is an
Arrow stream with ``doc_id, offset, size, n_tokens`` per document, so that a short document is
one small read away. A reader refuses a dictionary whose hash is not the one in the file.

Files go through ``pyarrow.fs``, which writes local and shared folders, HDFS and object stores.
A task writes to a name of its own and renames it when it is complete, so that a lost or repeated
task leaves no half file. A task holds one slice of documents and its index in memory.

Nulls, ties, repeats: a null text is empty and holds the end id only; null ids come first; rows
with the same doc_id follow each other in the order of their texts; extra columns are ignored; an
empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsift.llm.tokens import Encoder, encoder

MAGIC = b"TOKIDS01"
END_ID = 0
LEVEL = 3

#: The dictionary: its size, and the bounded sample it is trained on, documents and what of each.
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 1000
SAMPLE_CHARS = 4000

_INDEX = pa.schema(
    [("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())]
)
_MANIFEST = "shard bigint, n_docs bigint, n_tokens bigint"


def _sample(documents: DataFrame) -> list[str]:
    """A run of up to ``SAMPLE_CHARS`` characters from each of ``SAMPLE_DOCUMENTS`` documents.

    Ids are picked first, by their hashes and from a few times as many as are wanted, so that no
    texts meet but those of the sample. A long text gives a run from anywhere in it.
    """
    there = documents.select("doc_id", "text").where(F.length("text") > 0)
    parts, n = 1 << 30, documents.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    run = F.substring("text", F.pmod(F.xxhash64("text"), spare).cast("int") + 1, F.lit(SAMPLE_CHARS))
    for share in (16 * SAMPLE_DOCUMENTS / max(n, 1), 1.0):  # all, where few ids have many rows
        some = there.where(place < int(min(share, 1) * parts))
        ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = some.join(F.broadcast(ids.limit(SAMPLE_DOCUMENTS)), "doc_id")
        # an id may have any number of rows: one of them counts, combined before the shuffle
        rows = rows.groupBy("doc_id").agg(F.min(run).alias("text"))
        texts = sorted(row.text for row in rows.collect())
        if texts:
            return texts
    return []


def train_dictionary(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the ids of up to ``SAMPLE_DOCUMENTS`` documents, short or long.

    Any dictionary gives the same ids back; the sample decides on the size of the files only.
    Where there is too little to train on, the ids themselves are the dictionary.
    """
    end = np.array([end_id], "<u2").tobytes()
    samples = [ids + end for ids in Encoder(tokenizer, "spaced").encode(_sample(documents))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or end


def _shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:05d}.tok"


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, shards: int | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Encode and write all documents; the written manifest has a row per shard.

    One shuffle of the texts into ranges of doc_id; encoding, compression and writing follow it
    in the same tasks, so that nothing is encoded twice.
    """
    spark = documents.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = train_dictionary(documents, tokenizer, end_id)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary.zstd") as out:
        out.write(dictionary)
    end = np.array([end_id], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        work = encoder(tokenizer, "spaced")
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        files, root = fs.FileSystem.from_uri(folder)
        own = f"{root}/_writing-{uuid.uuid4().hex}"
        out, parts, n_docs, n_tokens = None, [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if out is None:
                    out = files.open_output_stream(own)
                    out.write(MAGIC + hashlib.sha256(dictionary).digest())
                    offset = len(MAGIC) + 32
                counts, sizes = [], []
                for ids in work.encode(part.column("text").to_pylist()):
                    frame = press.compress(ids + end)
                    out.write(frame)
                    counts.append(len(ids) // 2 + 1)
                    sizes.append(len(frame))
                offsets = offset + np.cumsum([0, *sizes], dtype=np.int64)
                offset = int(offsets[-1])
                columns = [part.column("doc_id"), offsets[:-1], sizes, counts]
                parts.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) if k else c for k, c in enumerate(columns)],
                        schema=_INDEX,
                    )
                )
                n_docs += len(counts)
                n_tokens += sum(counts)
        if out is None:
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _INDEX) as index:
            for part in parts:
                index.write_batch(part)
        index = sink.getvalue()
        out.write(index)
        out.write(struct.pack("<q", index.size) + MAGIC)
        out.close()
        files.move(own, _shard_name(root, shard))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in (shard, n_docs, n_tokens)],
            names=["shard", "n_docs", "n_tokens"],
        )

    ranges = documents.select("doc_id", "text").repartitionByRange(shards, "doc_id")
    ordered = ranges.sortWithinPartitions("doc_id", "text")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


class Shard:
    """A written shard: ``index`` as an Arrow table, and the ids of any of its documents."""

    def __init__(self, folder: str, shard: int):
        files, root = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(f"{root}/dictionary.zstd") as source:
            dictionary = source.read()
        self.file = files.open_input_file(_shard_name(root, shard))
        tail = len(MAGIC) + 8
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 32, 0)
        foot = self.file.read_at(tail, size - tail)
        if head[: len(MAGIC)] != MAGIC or foot[8:] != MAGIC:
            raise ValueError(f"{_shard_name(root, shard)} is not complete")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{_shard_name(root, shard)} was written with another dictionary")
        (length,) = struct.unpack("<q", foot[:8])
        self.index = pa.ipc.open_stream(self.file.read_at(length, size - tail - length)).read_all()
        self.unpress = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary)
        )

    def ids(self, offset: int, size: int) -> np.ndarray:
        """The ids in the frame at a place of the index; reads nothing else."""
        return np.frombuffer(self.unpress.decompress(self.file.read_at(size, offset)), "<u2")

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that id: the index tells where, nothing else is read."""
        rows = self.index.filter(pc.equal(self.index["doc_id"], doc_id)).to_pylist()
        return [self.ids(row["offset"], row["size"]) for row in rows]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: its place among all ids, its count, crc32 and, if asked, ids.

    The driver handles the manifest only, a row per shard.
    """
    start, rows = 0, []
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect()
    for row in manifest:
        rows.append((row.shard, start))
        start += row.n_tokens
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                shard, start = Shard(folder, one["shard"]), one["start"]
                for at in range(0, shard.index.num_rows, 1024):
                    out = []
                    for row in shard.index.slice(at, 1024).to_pylist():
                        ids = shard.ids(row["offset"], row["size"])
                        if len(ids) != row["n_tokens"]:
                            raise ValueError("a frame does not hold the ids its index tells of")
                        crc = zlib.crc32(ids.astype("<u4"))
                        out.append((row["doc_id"], start, len(ids), crc, *[ids.astype(np.int32)] * with_ids))
                        start += len(ids)
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                    )

    shards = spark.createDataFrame(rows, "shard bigint, start bigint")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.repartition(max(1, len(rows))).mapInArrow(
        load, schema + ", ids array<int>" * with_ids
    )
