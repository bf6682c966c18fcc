"""Packing along a space-filling curve: neighbouring documents share a sequence."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.llm.frames import quoted, ready, shared_table, shuffle_width, unpacked
from viewforge.llm.tokens import crc32, encoder, slices
from viewforge.llm.words import word_blocks

#: Length of the hashed document vectors, dimensions they are projected to, and bits of each on the curve.
HASHED, DIMENSIONS, BITS = 256, 4, 12
_PROJECTION = np.random.Generator(np.random.PCG64(7)).standard_normal((HASHED, DIMENSIONS))
NUMBERS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def curve_points(column: pa.Array) -> np.ndarray:
    """Each text as ``DIMENSIONS`` whole numbers of ``BITS`` bits; texts without words are at the middle.

    Words are hashed with a sign into a vector of fixed length, which is scaled to
    length one and projected by a fixed normal matrix.
    """
    points = np.zeros((len(column), DIMENSIONS))
    for words in word_blocks(column):
        n = len(words.counts)
        place = np.repeat(np.arange(n) * HASHED, words.counts) + (words.hashes % np.uint64(HASHED)).astype(np.int64)
        sign = 1.0 - 2.0 * (words.hashes >> np.uint64(63)).astype(float)
        vectors = np.bincount(place, sign, n * HASHED).reshape(n, HASHED)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        points[words.rows] = (vectors / np.where(length > 0, length, 1)) @ _PROJECTION
    # A logistic curve stands in for the normal distribution function: every cell gets its share.
    return np.minimum((1 << BITS) / (1 + np.exp(-1.702 * points)), (1 << BITS) - 1).astype(np.int64)


def hilbert_key(points: np.ndarray) -> np.ndarray:
    """Position on the Hilbert curve, by Skilling's transposition (AIP Conf. Proc. 707, 2004)."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def pack_along_curve(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, text: str = "text", by_word: bool = False
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, neighbours on the curve side by side.

    A document is its text's ids and ``end_id``; a null text is empty. The documents
    in curve order are one stream, cut every ``length`` tokens, so only the very last
    sequence can be shorter. Returns one row per piece: the columns of ``docs`` but the
    text, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence) and ``ids``
    (little-endian unsigned 32-bit). Repeated rows are separate documents; columns that
    have the name of a result column are replaced; an empty table has no pieces.

    One range shuffle of the texts by Hilbert key and row number; equal texts have equal
    keys, and the row number splits them. The stream's ids are written once to the shared
    folder, because a piece's place depends on the totals of all parts before it. Those
    totals are one row per part, which bounds their broadcast.
    """
    spark = docs.sparkSession
    ready(spark)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*([quoted(c) for c in others] or [F.lit(0).alias("none")])).alias("row"), quoted(text).alias("text"))
    keyed = T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])
    numbered = rows.mapInArrow(_keyed, keyed).withColumn("number", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(shuffle_width(spark), "key", "number").sortWithinPartitions("key", "number")
    stream = T.StructType(
        [
            rows.schema["row"],
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    tokens = shared_table(ranged.select("row", "text").mapInArrow(_stream(tokenizer, by_word, end_id), stream), "curve")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tokens.join(F.broadcast(totals.select("part", before.alias("base"))), "part")
    piece = T.StructType([rows.schema["row"], *(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("ids", T.BinaryType())])
    cut = placed.select("row", F.expr("base + first").alias("place"), "n", "ids").mapInArrow(_pieces(length), piece)
    return unpacked(cut, others, [*NUMBERS, "ids"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array(hilbert_key(curve_points(batch.column(1))), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["row", "text", "key"])


def _stream(tokenizer: str, by_word: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(tokenizer, by_word), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        for batch in chain.from_iterable(map(slices, batches)):
            ids = [i + end for i in encode(batch.column(1).to_pylist())]
            n = np.array([len(i) // encode.width for i in ids], np.int64)
            at = first + np.cumsum(n) - n
            first += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(at), pa.array(n), pa.array(ids, pa.binary())],
                ["row", "part", "first", "n", "ids"],
            )

    return run


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            rows, out = [], []
            for row, (place, n, data) in enumerate(zip(*(c for c in batch.columns[1:]), strict=True)):
                place, n, raw, start = place.as_py(), n.as_py(), data.as_buffer(), 0
                ids = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4")
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    piece = ids[start : start + length - offset]
                    rows.append(row)
                    out.append((start, len(piece), crc32(piece), n, sequence, offset, piece.tobytes()))
                    start += len(piece)
            columns = list(zip(*out, strict=True))
            numbers = [pa.array(c, pa.int64()) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), *numbers, pa.array(columns[-1], pa.binary())], ["row", *NUMBERS, "ids"]
            )

    return run
