"""Token files of directly addressable codes: any token is read without decoding a block.

Each id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id;
level k + 1 holds the next chunk of those ids that need it. A bitmap per level marks
the ids that continue, and a rank directory holds the number of marks before each
512 bits, so that a position in one level leads to its position in the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.llm.frames import quoted, ready, shuffle_width
from viewforge.llm.tokens import crc32, encoder, slices

CHUNK_BITS = 8
RANK_BITS = 512
#: Tokens of one shard; a longer document is kept whole.
SHARD_TOKENS = 1 << 20
MAGIC = b"DAC1"


def encode_codes(ids: np.ndarray) -> bytes:
    """Ids as levels, continuation bitmaps and rank directories."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        goes_on = rest >= 1 << CHUNK_BITS
        levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), goes_on))
        if not goes_on.any():
            break
        rest = rest[goes_on] >> np.uint64(CHUNK_BITS)
    parts = [MAGIC, np.array([len(levels)], "<u4").tobytes()]
    for chunks, goes_on in levels:
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8))
        marks = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(marks))).astype("<u4")
        parts += [np.array([len(chunks), len(bits), len(ranks)], "<u8").tobytes(), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Codes:
    """Random access to encoded ids; the bytes are looked at in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.levels, at = [], 8
        for _ in range(int(np.frombuffer(data, "<u4", 1, 4)[0])):
            n, n_bits, n_ranks = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
            at += 24
            chunks, bits = np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, n_bits, at + n)
            at += n + n_bits
            self.levels.append((chunks, bits, np.frombuffer(data, "<u4", n_ranks, at)))
            at += 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + CHUNK_BITS
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before bit ``i``: the directory, then whole bytes of its block, then the rest of one byte."""
        block = i // RANK_BITS
        first, byte = block * RANK_BITS // 8, i >> 3
        part = int(bits[byte]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + int(np.bitwise_count(bits[first:byte]).sum()) + part.bit_count()

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive)."""
        values = np.zeros(max(0, end - start), np.uint32)
        where, shift = np.arange(len(values)), 0
        for chunks, bits, ranks in self.levels:
            if start >= end:
                break
            values[where] |= chunks[start:end].astype(np.uint32) << np.uint32(shift)
            low = start >> 3
            marks = np.unpackbits(bits[low : (end + 7) >> 3], bitorder="little")[start - 8 * low : end - 8 * low].astype(bool)
            where, shift = where[marks], shift + CHUNK_BITS
            start = self._rank(bits, ranks, start)
            end = start + len(where)
        return values


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", by_word: bool = False
) -> None:
    """Write the ids of all texts under ``path``, in ascending order of the id column.

    Each text is encoded without special tokens and ``end_id`` is appended; a null
    text is empty. Rows of equal id are ordered by a hash of the text; a null id comes
    first; equal rows are all written. An empty table gives a folder without shards.

    ``path`` is a Parquet folder with one row per shard of about a million tokens:
    ``part`` and ``first`` (tokens before it in that part) place it, ``doc_ids`` and
    ``doc_tokens`` are its directory and ``codes`` holds the encoded ids. Parts are
    ranges of the id column, as many as shuffle partitions; a hash and a row number
    split an id that holds very many rows.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(
        quoted(id).alias("doc_id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("tie"), F.monotonically_increasing_id().alias("row")
    )
    order = ["doc_id", "tie", "row"]
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = ranged.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("doc_tokens", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    shards = ranged.mapInArrow(_shards(tokenizer, by_word, end_id), schema)
    shards.write.option("compression", "none").parquet(path)


def _shards(tokenizer: str, by_word: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(tokenizer, by_word), TaskContext.get().partitionId(), 0
        kind, end = f"<u{encode.width}", np.array([end_id], f"<u{encode.width}").tobytes()
        doc_ids, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = [len(i) // encode.width for i in ids]
            codes = encode_codes(np.frombuffer(b"".join(ids), kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.ListArray.from_arrays([0, len(doc_ids)], pa.array(doc_ids, id_type)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([codes], pa.binary()),
                ],
                ["part", "first", "n_tokens", "doc_ids", "doc_tokens", "codes"],
            )

        for batch in chain.from_iterable(map(slices, batches)):
            id_type = batch.column(0).type
            for doc_id, encoded in zip(batch.column(0), encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id.as_py())
                ids.append(encoded + end)
                size += len(ids[-1]) // encode.width
                if size >= SHARD_TOKENS:
                    yield shard()
                    first, doc_ids, ids, size = first + size, [], [], 0
        if ids:
            yield shard()

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start`` (tokens of all documents before), ``n_tokens``, ``ids_crc32``.

    Each document's ids are fetched by position. Only the token total of each part
    is shuffled; it has one row per part, which bounds the broadcast.
    """
    ready(spark)
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.join(F.broadcast(totals.select("part", before.alias("base"))), "part")
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]
    )
    return placed.select(F.expr("base + first").alias("at"), "doc_ids", "doc_tokens", "codes").mapInArrow(_documents, schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, doc_ids, lengths, codes in zip(*batch.columns, strict=True):
            ids = Codes(codes.as_py())
            lengths = np.array(lengths.as_py(), np.int64)
            ends = np.cumsum(lengths)
            sums = [crc32(ids.slice(int(e - n), int(e))) for n, e in zip(lengths, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.values,
                    pa.array(at.as_py() + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
