"""Token ids in binary files of patched frame-of-reference blocks, and back.

A file holds blocks, then a footer. A block of up to ``BLOCK`` ids is: count (u32), minimum (u32),
width (u8), exceptions (u16), the low ``width`` bits of every id less the minimum, packed, then
for each exception its place (u16) and its bits above the width (u32). The width is the least
that holds a given share of the ids. The footer is: document ids (i64), their null flags (u8),
ids up to each document's end (i64), block starts (i64), then the numbers of documents and
blocks (i64 each) and ``MAGIC``. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import open_store, replace_file, shared_folder, tidy
from strandline.llm.tokens import token_arrays

MAGIC = b"PFORIDS1"
BLOCK = 4096
SHARE = 0.9
TAIL, TAIL_BYTES = "<qq8s", 24
HEAD, HEAD_BYTES = "<IIBH", 11
GATHER = 64
MANIFEST = "part int, file string, ids long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def _unpack(packed: bytes, count: int, width: int) -> np.ndarray:
    bits = np.zeros((count, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(packed, np.uint8), count=count * width,
                                        bitorder="little").reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block of 1 to 65,535 ids below 2^32."""
    ids = np.asarray(ids, np.uint32)
    least = ids.min()
    rest = ids - least
    at = min(len(rest) - 1, int(np.ceil(share * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    places = np.flatnonzero(high)
    return (struct.pack(HEAD, len(ids), int(least), width, len(places)) + _pack(rest, width)
            + places.astype("<u2").tobytes() + high[places].astype("<u4").tobytes())


def decode_block(block: bytes) -> np.ndarray:
    count, least, width, exceptions = struct.unpack_from(HEAD, block)
    at = HEAD_BYTES + (count * width + 7) // 8
    rest = _unpack(block[HEAD_BYTES:at], count, width)
    if exceptions:
        places = np.frombuffer(block, "<u2", exceptions, at)
        rest[places] |= np.frombuffer(block, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
    return rest + np.uint32(least)


class Writer:
    """Blocks as ids come in, the footer at the end; holds less than a block of ids."""

    def __init__(self, out, block: int = BLOCK, share: float = SHARE):
        self.out, self.block, self.share = out, block, share
        self.place = self.ids = 0
        self.starts, self.docs, self.nulls, self.ends = [], [], bytearray(), []
        self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ids += len(ids)
        self.ends.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= GATHER * self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if rest else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            packed = encode_block(ids[at:min(at + self.block, whole)], self.share)
            self.starts.append(self.place)
            self.out.write(packed)
            self.place += len(packed)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.starts.append(self.place)
        for values in (self.docs, None, self.ends, self.starts):
            self.out.write(bytes(self.nulls) if values is None else np.array(values, "<i8").tobytes())
        self.out.write(struct.pack(TAIL, len(self.docs), len(self.starts) - 1, MAGIC))


class Reader:
    """Documents of a file, and any range of its ids through the block starts."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        docs, blocks, magic = struct.unpack(TAIL, source.read_at(TAIL_BYTES, size - TAIL_BYTES))
        if magic != MAGIC:
            raise ValueError("not a file of token id blocks")
        footer = 17 * docs + 8 * (blocks + 1)
        raw = source.read_at(footer, size - TAIL_BYTES - footer)
        self.docs = np.frombuffer(raw, "<i8", docs)
        self.nulls = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.ends = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.frombuffer(raw, "<i8", blocks + 1, 17 * docs)

    def blocks(self, first: int = 0, last: int | None = None):
        """Ids of the blocks ``first`` to before ``last``, ``GATHER`` blocks at a time."""
        last = len(self.starts) - 1 if last is None else last
        for at in range(first, last, GATHER):
            stop = min(at + GATHER, last)
            base = int(self.starts[at])
            raw = self.source.read_at(int(self.starts[stop]) - base, base)
            yield np.concatenate([decode_block(raw[int(self.starts[i]) - base:int(self.starts[i + 1]) - base])
                                  for i in range(at, stop)])

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian 32-bit integers."""
        sums = np.zeros(len(self.docs), np.int64)
        doc = seen = 0
        for ids in self.blocks():
            raw, at = ids.astype("<u4").tobytes(), 0
            while at < len(ids):
                while self.ends[doc] <= seen:
                    doc += 1
                take = min(len(ids) - at, int(self.ends[doc]) - seen)
                sums[doc] = zlib.crc32(raw[4 * at:4 * (at + take)], int(sums[doc]))
                at, seen = at + take, seen + take
        return sums


def write_ids(docs: DataFrame, folder: str, tokenizer: str, parts: int, key: str = "doc_id",
              text: str = "text", end: int = 0, block: int = BLOCK, share: float = SHARE) -> DataFrame:
    """Write one file per range of keys, in ascending order; returns part, file and number of ids."""
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(
        parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def write(batches):
        part = TaskContext.get().partitionId()
        target = f"{folder}/part-{part:06d}.ids"
        counts = []

        def fill(out):
            writer = Writer(out, block, share)
            for batch in batches:
                arrays = token_arrays(tokenizer, batch.column(1).to_pylist(), end)
                for doc_id, ids in zip(batch.column(0).to_pylist(), arrays):
                    writer.add(doc_id, ids)
            writer.close()
            counts.append(writer.ids)

        replace_file(target, fill)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([target]), pa.array(counts, pa.int64())],
            ["part", "file", "ids"])

    ordered.mapInArrow(lambda batches: tidy(write(batches)), MANIFEST).write.parquet(f"{folder}-manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of all files with the number of ids before them, their own, and a checksum.

    The driver adds up the sizes of the files, one number for each.
    """
    spark = manifest.sparkSession
    base, files = 0, []
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((row.file, base))
        base += row.ids
    listed = spark.createDataFrame(files, "file string, base long").repartition(
        max(1, len(files)), "file")

    def read(batches):
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = open_store(file)
                with store.open_input_file(path) as source:
                    reader = Reader(source)
                    sums = reader.checksums()
                ends = reader.ends
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.docs, mask=reader.nulls), pa.array(starts + start),
                     pa.array(ends - starts), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, DOCUMENT)


def store_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 end: int = 0, parts: int | None = None, folder: str | None = None) -> DataFrame:
    """Tokenise whole texts, store their ids in ascending key order, read the files back.

    Returns ``doc_id``, ``start``, ``n_tokens`` (with the end id) and ``ids_crc32``. A null or
    empty text is the end id alone. Null keys come first; rows of the same key stay rows of their
    own, ordered by text with nulls first. Other columns are not read. No documents give no rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or shared_folder(spark, "token-ids")
    return read_ids(write_ids(docs, folder, tokenizer, parts, key, text, end))
