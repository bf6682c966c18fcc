"""Substring deduplication: remove every word covered by a window that occurs twice or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import packed, quoted, ready, shuffle_width, text_key, unpacked
from viewforge.llm.words import mixed, word_blocks
from viewforge.operators.joins import SPREAD, group_for_join

#: Words of one block, whose windows are sent together. A longer document makes a block of its own.
BLOCK_WORDS = 1 << 20
INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
KEPT = "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
SENT = "bucket int, block long, kind int, payload binary"
KEY_BYTES = 16
DIRECTORY, ENTRIES = 0, 1


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` and ``kept_text``.

    A window is ``window`` consecutive words of one document; a word is a run of
    anything but ASCII white space. Words covered by a window whose words also
    start anywhere else, in any row, go. ``removed`` lists the maximal removed
    intervals as word positions (end exclusive); ``kept_text`` joins the rest by
    one blank. All windows are judged on the input.

    Null and empty texts, and texts of fewer words than the window, lose nothing
    (a null has no words and an empty ``kept_text``). Equal rows count as
    occurrences of each other. Columns of the table that have the name of a
    result column are replaced. An empty table gives an empty result.

    Work: documents are hashed in blocks; a block sends each distinct Rabin-Karp
    window hash (64 bits) once to the hash's bucket, so a window that fills a third of
    the table costs one entry per block. A bucket answers each block with the
    positions whose hash another block has too. There are as many buckets as
    shuffle partitions. Answers meet the document by a key of its text, so repeated
    ids do not matter. Two different windows share a hash with probability
    windows / 2**64.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = packed(docs, key=text_key(quoted(text)))
    body = F.col("row").getField(text)
    buckets = shuffle_width(spark)
    sent = docs.select(text_key(quoted(text)), quoted(text)).where(quoted(text).isNotNull()).mapInArrow(_sender(window, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answers, "block long, kind int, payload binary")
    found = answers.groupBy("block").applyInArrow(_intervals(window), "key binary, removed binary")
    removed = group_for_join(found, ["key"]).agg(F.first("removed").alias("removed")).drop(SPREAD)
    kept = F.arrow_udf(_keep, KEPT)(body, F.col("removed"))
    joined = rows.join(removed, "key", "left").select("row", kept.alias("kept"))
    new = ["n_words", "n_removed", "removed", "kept_text"]
    return unpacked(joined.select("row", "kept.*"), docs.columns, new)


class _Block:
    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.n = 0


def _sender(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            keys = batch.column(0)
            for words in word_blocks(batch.column(1)):
                hashes, _, first = words.windows(window)
                block.keys += keys[words.rows.start : words.rows.stop].to_pylist()
                block.counts.append(np.diff(first))
                block.hashes.append(hashes)
                block.n += len(hashes)
                if block.n >= BLOCK_WORDS:
                    yield _sent(block, (part << 32) + number, buckets)
                    number, block = number + 1, _Block()
        if block.n:
            yield _sent(block, (part << 32) + number, buckets)

    return run


def _sent(block: _Block, number: int, buckets: int) -> pa.RecordBatch:
    """One row per bucket with the block's distinct hashes there, and the block's directory."""
    hashes = np.concatenate(block.hashes)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    run = np.flatnonzero(fresh)
    length = np.diff(np.append(run, len(ranked)))
    repeated = np.sort(order[np.repeat(length > 1, length)])
    at, many = order[run], length > 1
    back = np.argsort(at)
    at, many = at[back], many[back]
    values = hashes[at]
    to = (mixed(values) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets + 1))
    counts = np.concatenate(block.counts).astype(np.int64)
    home = number % buckets
    out = [(home, number, DIRECTORY, _directory(block.keys, counts, repeated))]
    for bucket in range(buckets):
        own = by[edges[bucket] : edges[bucket + 1]]
        if len(own):
            out.append((bucket, number, ENTRIES, values[own].tobytes() + _gaps(at[own] * 2 + many[own])))
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
        ["bucket", "block", "kind", "payload"],
    )


def _gaps(rising: np.ndarray) -> bytes:
    """Rising numbers as compressed gaps, byte by byte of the same rank, with their count ahead."""
    gaps = np.diff(rising, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    body = pa.compress(np.ascontiguousarray(gaps).tobytes(), "zstd", asbytes=True)
    return body + len(rising).to_bytes(4, "little")


def _ungapped(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    raw = pa.decompress(data[:-4], 4 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64))


def _directory(keys: list[bytes], counts: np.ndarray, repeated: np.ndarray) -> bytes:
    head = len(keys).to_bytes(8, "little")
    return head + b"".join(keys) + counts.tobytes() + _gaps(repeated)


def _answers(table: pa.Table) -> pa.Table:
    """For each block the positions whose hash occurs more than once; directories pass through."""
    blocks, kinds, payloads = table["block"].to_pylist(), table["kind"].to_pylist(), table["payload"].to_pylist()
    out = [(b, k, p) for b, k, p in zip(blocks, kinds, payloads, strict=True) if k == DIRECTORY]
    entries = [(b, p) for b, k, p in zip(blocks, kinds, payloads, strict=True) if k == ENTRIES]
    if entries:
        at, hashes = [], []
        for _, payload in entries:
            n = int.from_bytes(payload[-4:], "little")
            hashes.append(np.frombuffer(payload, np.uint64, n))
            at.append(_ungapped(payload[8 * n :]))
        sizes = [len(h) for h in hashes]
        values, marks = np.concatenate(hashes), np.concatenate(at)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        same = np.zeros(len(ranked), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= same[1:]
        hit = np.empty(len(ranked), bool)
        hit[order] = same
        for (block, _), hits, marked in zip(
            entries, np.split(hit, np.cumsum(sizes)[:-1]), np.split(marks, np.cumsum(sizes)[:-1]), strict=True
        ):
            # A window that its own block has twice is already in the block's directory.
            found = marked[hits & (marked % 2 == 0)] // 2
            if len(found):
                out.append((block, ENTRIES, _gaps(found)))
    return pa.table(
        {
            "block": pa.array([o[0] for o in out], pa.int64()),
            "kind": pa.array([o[1] for o in out], pa.int32()),
            "payload": pa.array([o[2] for o in out], pa.binary()),
        }
    )


def _intervals(window: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
        head = next(p for k, p in zip(kinds, payloads, strict=True) if k == DIRECTORY)
        n = int.from_bytes(head[:8], "little")
        keys = [head[8 + KEY_BYTES * i : 8 + KEY_BYTES * (i + 1)] for i in range(n)]
        rest = 8 + KEY_BYTES * n
        first = np.concatenate(([0], np.cumsum(np.frombuffer(head[rest : rest + 8 * n], np.int64))))
        found = [_ungapped(head[rest + 8 * n :])] + [_ungapped(p) for k, p in zip(kinds, payloads, strict=True) if k == ENTRIES]
        starts = np.sort(np.concatenate(found))
        cuts = np.searchsorted(starts, first)
        out_keys, out = [], []
        for i in np.flatnonzero(np.diff(cuts)):
            out_keys.append(keys[i])
            out.append(_merged(starts[cuts[i] : cuts[i + 1]] - first[i], window))
        return pa.table({"key": pa.array(out_keys, pa.binary()), "removed": pa.array(out, pa.binary())})

    return run


def _merged(starts: np.ndarray, window: int) -> bytes:
    """Maximal intervals covered by the windows at ``starts``, as pairs of 32-bit positions."""
    opens = np.concatenate(([True], np.diff(starts) > window))
    closes = np.append(opens[1:], True)
    return np.stack([starts[opens], starts[closes] + window], 1).astype("<i4").tobytes()


def _keep(texts: pa.Array, intervals: pa.Array) -> pa.Array:
    n_words, n_removed, removed, kept = [], [], [], []
    for text, found in zip(texts, intervals, strict=True):
        words = (text.as_py() or "").encode().split()
        pairs = np.frombuffer(found.as_py() or b"", "<i4").reshape(-1, 2).tolist()
        n_words.append(len(words))
        n_removed.append(sum(end - start for start, end in pairs))
        removed.append([{"start": start, "end": end} for start, end in pairs])
        for start, end in reversed(pairs):
            del words[start:end]
        kept.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, INTERVALS), pa.array(kept, pa.string())],
        ["n_words", "n_removed", "removed", "kept_text"],
    )
