"""Token-id files: ids in as few bits as the vocabulary needs, written in document order and read at random.

A file holds blocks of packed ids and ends with its index::

    "LTOK" | blocks ... | per block: byte offset, first id (two unsigned 64-bit integers) | per document: doc_id
    (signed 64-bit), first id in the file (unsigned 64-bit) | footer

The footer has the bits of an id, the numbers of blocks, documents, ids and documents of null doc_id (which come
first), as six little-endian unsigned 64-bit integers with the index's offset, and "LTOK" again. Blocks have
``BLOCK`` ids each, the last fewer, and start at a whole byte: id n is in block n // BLOCK.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from loomspark.llm import pretoken
from loomspark.llm.common import arrow, fresh_path, id_and_text, sliced, through_table
from loomspark.llm.token_counts import TOKENIZER, loaded

MAGIC = b"LTOK"
BLOCK = 1 << 16
FOOTER = struct.Struct("<6Q4s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids end to end, the lowest bit first: eight ids fill ``bits`` bytes."""
    rows = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 8)
    out = np.zeros((len(rows), bits), np.uint64)
    for i in range(8):
        for byte in range(i * bits // 8, -(-(i + 1) * bits // 8)):
            shift = i * bits - 8 * byte
            out[:, byte] |= rows[:, i] << np.uint64(shift) if shift >= 0 else rows[:, i] >> np.uint64(-shift)
    return out.astype(np.uint8).tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids that were packed."""
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = raw.reshape(groups, bits).astype(np.uint32 if bits <= 16 else np.uint64)
    out = np.zeros((groups, 8), raw.dtype)
    for i in range(8):
        for byte in range(i * bits // 8, -(-(i + 1) * bits // 8)):
            shift = i * bits - 8 * byte
            part = raw[:, byte] >> raw.dtype.type(shift) if shift >= 0 else raw[:, byte] << raw.dtype.type(-shift)
            out[:, i] |= part
    return (out.ravel()[:n] & raw.dtype.type((1 << bits) - 1)).astype(np.uint32)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Writer:
    """Writes one file, block by block; memory holds one block and the index."""

    sink: pa.NativeFile
    bits: int
    waiting: list[np.ndarray] = field(default_factory=list)
    n_waiting: int = 0
    n_ids: int = 0
    offsets: list[int] = field(default_factory=list)
    doc_ids: list = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in order; ids: all of theirs, end to end."""
        first = self.n_ids + np.cumsum(sizes) - sizes
        self.doc_ids += doc_ids
        self.starts += first.tolist()
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            joined = np.concatenate(self.waiting)
            whole = len(joined) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(joined[k : k + BLOCK])
            self.waiting, self.n_waiting = [joined[whole:]], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.sink.write(data := pack(ids, self.bits))
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        n_null = sum(d is None for d in self.doc_ids)
        blocks = np.stack([np.array(self.offsets, "<u8"), np.arange(len(self.offsets), dtype="<u8") * BLOCK], 1)
        self.sink.write(blocks.tobytes())
        self.sink.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(FOOTER.pack(self.bits, len(self.offsets), len(self.doc_ids), self.n_ids, n_null, self.at, MAGIC))
        self.sink.close()


class Reader:
    """Reads a file's index, and the ids of any documents or range."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        source.seek(size - FOOTER.size)
        self.bits, n_blocks, self.n_docs, self.n_ids, self.n_null, at, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        index = source.read(size - FOOTER.size - at)
        self.offsets = np.append(np.frombuffer(index, "<u8", 2 * n_blocks).reshape(-1, 2)[:, 0], np.uint64(at)).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, 16 * n_blocks)
        self.starts = np.append(np.frombuffer(index, "<u8", self.n_docs, 16 * n_blocks + 8 * self.n_docs), np.uint64(self.n_ids)).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from begin to end: only the blocks that hold them are read."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base = int(self.offsets[first])
        parts = [unpack(data[self.offsets[k] - base : self.offsets[k + 1] - base], min(BLOCK, self.n_ids - k * BLOCK), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[begin - first * BLOCK : end - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self, most: int = 16 * BLOCK):
        """(from, to) of runs of documents with about ``most`` ids."""
        begin = 0
        while begin < self.n_docs:
            end = int(np.searchsorted(self.starts, self.starts[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), self.n_docs)
            yield begin, end
            begin = end


@cache
def encoder(path: str) -> tuple[pretoken.WordIds, dict[str, int]]:
    tokenizer, added = loaded(path)
    specials = {t: tokenizer.token_to_id(t) for t in added}
    return pretoken.WordIds(lambda words: pretoken.encoded_words(tokenizer, words)), specials


MANIFEST = pa.schema([("file", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, directory: str, path: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents, each followed by ``end_id``, in ascending order of doc_id; null comes first.

    One file for each range of doc_id. Returns the manifest: file (in the ids' order), name, n_docs, n_ids, start
    (ids in the files before it). Only files that the manifest names count: an attempt that was lost leaves
    another file, of its own name. Null text is empty and has the end id alone; repeated rows are all written. Long
    texts are encoded in parts cut between pre-tokens. No rows: no files.
    """
    spark = docs.sparkSession
    bits = bits_for(loaded(path)[0].get_vocab_size(with_added_tokens=True))

    def write(batches):
        from pyspark import TaskContext

        words, specials = encoder(path)
        files, root = located(directory)
        files.create_dir(root, recursive=True)
        name, writer = f"{uuid.uuid4().hex}.ids", None
        for batch in sliced(batches):
            if writer is None:
                writer = Writer(files.open_output_stream(f"{root}/{name}"), bits)
            found, sizes = pretoken.encoded_whole(batch.column(1).to_pylist(), words, True, specials)
            writer.add(batch.column(0).to_pylist(), np.insert(found, np.cumsum(sizes), end_id), sizes + 1)
        if writer:
            writer.close()
            yield arrow({"file": [TaskContext.get().partitionId()], "name": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]}, MANIFEST)

    docs = id_and_text(docs).select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = through_table(ranges.mapInArrow(write, "file long, name string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""

    def documents(batches):
        files, root = located(directory)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{row['name']}") as source:
                    reader = Reader(source)
                    for a, b in reader.runs():
                        starts = reader.starts[a : b + 1]
                        data = memoryview(reader.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                        at = ((starts - starts[0]) * 4).tolist()
                        yield arrow(
                            {
                                "doc_id": [None if a + k < reader.n_null else d for k, d in enumerate(reader.doc_ids[a:b].tolist())],
                                "start": starts[:-1] + row["start"],
                                "n_tokens": np.diff(starts),
                                "ids_crc32": [zlib.crc32(data[i:j]) for i, j in zip(at, at[1:])],
                            },
                            READ,
                        )

    rows = manifest.select("name", "start").collect()  # one a file
    spark = manifest.sparkSession
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType())])
    spread = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)
    return spread.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, path: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """Write the documents' token files in the shared folder, read them back, and return a row for each document."""
    directory = fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, directory, path, end_id), directory)
