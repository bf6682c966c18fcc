"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each shard holds the postings of some documents, as
search engines do, so that all lists of a phrase meet in one place and a search
shuffles nothing. A shard row has a sorted dictionary of word hashes, where each
word's postings begin, and the postings: rising positions in the shard's word stream,
in which a gap after each document keeps a phrase from crossing into the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewforge.llm.frames import quoted, ready, shared_table, unpacked
from viewforge.llm.words import ALPHANUMERIC, LOWER, word_blocks

#: Words of one shard; a longer document makes a shard of its own.
SHARD_WORDS = 1 << 19
#: Free positions after each document: wider than any window and slack.
GAP = 1 << 10
#: Bytes of item texts that are searched for at a time; that bounds what is sent to every task.
QUERY_BYTES = 4 << 20
HIT = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("exact", T.BooleanType()),
    ]
)


def build_index(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Shards over all words of all texts: ASCII letters lower-cased, letters, digits and all beyond ASCII are words.

    ``carry`` names columns that identify a document in the result. A null text has no
    words. The frame is lazy; :func:`decontaminate` stores it in the shared folder.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.struct(*(quoted(c) for c in carry)).alias("row"), quoted(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)),
            T.StructField("counts", T.BinaryType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("postings", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(_index, schema)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, counts, hashes, size, kind = [], [], [], 0, None

    def shard() -> pa.RecordBatch:
        n, words = np.concatenate(counts), np.concatenate(hashes)
        at = np.arange(len(words)) + np.repeat(np.arange(len(n)) * GAP, n)
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, int)
        lengths = np.diff(np.append(first, len(ranked)))
        documents = pa.concat_arrays(rows)
        parts = [n.astype("<u4"), ranked[first], lengths.astype("<u4"), at[order].astype("<u4" if len(at) == 0 or at[-1] < 1 << 32 else "<u8")]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays([0, len(documents)], documents), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
            ["rows", "counts", "terms", "lengths", "postings"],
        )

    for batch in batches:
        for words in word_blocks(batch.column(1), ALPHANUMERIC, LOWER):
            rows.append(batch.column(0).slice(words.rows.start, words.rows.stop - words.rows.start))
            counts.append(words.counts)
            hashes.append(words.hashes)
            size += len(words.hashes)
            if size >= SHARD_WORDS:
                yield shard()
                rows, counts, hashes, size = [], [], [], 0
    if rows:
        yield shard()


class Shard:
    """One shard's lists, looked at in place."""

    def __init__(self, counts: bytes, terms: bytes, lengths: bytes, postings: bytes) -> None:
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))
        width = len(postings) // max(1, int(self.counts.sum()))
        self.at = np.frombuffer(postings, f"<u{width or 4}")
        self.begins = np.concatenate(([0], np.cumsum(self.counts)[:-1])) + np.arange(len(self.counts)) * GAP

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each wanted word's list begins and how long it is; 0 if the shard has none."""
        i = np.minimum(np.searchsorted(self.terms, wanted), max(0, len(self.terms) - 1))
        if not len(self.terms):
            return np.zeros(len(wanted), int), np.zeros(len(wanted), int)
        begins = np.where(i > 0, self.ends[i - 1], 0)
        return begins, np.where(self.terms[i] == wanted, self.ends[i] - begins, 0)


@dataclass
class Phrases:
    """Windows of the items: word numbers by window (-1 beyond a short one), their length and item."""

    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None], window: int) -> Phrases:
        found: set[tuple[int, tuple[int, ...]]] = set()
        for block in word_blocks(pa.array(texts, pa.string()), ALPHANUMERIC, LOWER):
            for i, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
                words = block.hashes[a:b].tolist()
                ends = range(window, len(words) + 1) if len(words) > window else [len(words)] if words else []
                found.update((block.rows.start + i, tuple(words[max(0, e - window) : e])) for e in ends)
        ordered = sorted(found)
        vocabulary = np.unique(np.array([w for _, ws in ordered for w in ws], np.uint64))
        table = np.full((len(ordered), window), -1)
        for row, (_, words) in zip(table, ordered, strict=True):
            row[: len(words)] = np.searchsorted(vocabulary, np.array(words, np.uint64))
        return cls(vocabulary, table, np.array([len(ws) for _, ws in ordered], int), np.array([i for i, _ in ordered], int))


def matches(shard: Shard, phrases: Phrases, slack: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Item, length, starts and exactness of every phrase that occurs, from its rarest word in this shard."""
    if not len(phrases.lengths):
        return
    begins, counts = shard.places(phrases.vocabulary)
    sizes = np.where(phrases.words >= 0, counts[phrases.words], np.iinfo(np.int64).max)
    for w in np.flatnonzero(sizes.min(1) > 0):
        n = phrases.lengths[w]
        offsets = np.argsort(sizes[w, :n], kind="stable")
        words = phrases.words[w]
        starts = exact = None
        for offset in offsets:
            word = words[offset]
            found = shard.at[begins[word] : begins[word] + counts[word]].astype(np.int64) - offset
            if starts is None:
                starts, exact = found, np.ones(len(found), bool)
                continue
            i = np.minimum(np.searchsorted(found, starts - slack), len(found) - 1)
            near = np.abs(found[i] - starts) <= slack
            if slack:
                j = np.minimum(np.searchsorted(found, starts), len(found) - 1)
                exact &= found[j] == starts
            starts, exact = starts[near], exact[near]
            if not len(starts):
                break
        if len(starts):
            yield phrases.items[w], n, starts, exact


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    slack: int = 0,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Where windows of ``window`` consecutive item words occur in the documents, one row per document.

    Columns: ``carry``, ``n_words``, ``hits`` (item, first word, end, whether exact),
    ``n_hit`` (words inside any hit), ``items`` (sorted ids of the items that occur) and
    ``contaminated``. An item of fewer words, but not none, is one window. ``slack`` 0
    finds exact phrases; otherwise each word may lie that many places from where the
    phrase's rarest word puts it, and a hit that is not exact covers the slack too.

    Null and empty texts have no words, whether of documents or items. Items without an
    id cause hits but are not listed. Repeated documents are reported each; repeated items
    count once. Empty tables give an empty result, or one without hits.

    The index is written to the shared folder. Items are searched for in blocks of about
    ``QUERY_BYTES`` bytes; a block's windows are sent to every task, and its size is
    checked by the division into blocks. Every shard is searched for every block.
    """
    spark = docs.sparkSession
    if window + 2 * slack >= GAP:
        raise ValueError(f"window and slack must stay below {GAP}")
    index = shared_table(build_index(docs, carry, text).withColumn("shard", F.monotonically_increasing_id()), "postings")
    wanted = items.select(quoted(item_id).cast("string").alias("id"), quoted(item_text).alias("text")).where("text IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    found = None
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        phrases = spark.sparkContext.broadcast((Phrases.of([r["text"] for r in own], window), [r["id"] for r in own]))
        part = index.mapInArrow(_search(phrases, slack), _found_schema(index))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("shard", "place").agg(
            F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits")
        )
    listed = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item"]), lambda i: i.isNotNull())))
    covered = F.arrow_udf(_covered_words, "long")(F.col("hits"))
    out = found.select("row", "n_words", "hits", covered.alias("n_hit"), listed.alias("items"), (F.size("hits") > 0).alias("contaminated"))
    new = [c for c in out.columns if c != "row"]
    return unpacked(out, list(carry), new)


def _found_schema(index: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("row", index.schema["rows"].dataType.elementType),
            T.StructField("shard", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.ArrayType(HIT)),
        ]
    )


def _search(query, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, ids = query.value
        for batch in batches:
            for rows, *parts, number in zip(*batch.columns, strict=True):
                yield _found(rows.values, number.as_py(), Shard(*(p.as_py() for p in parts)), phrases, ids, slack)

    return run


def _found(rows: pa.Array, number: int, shard: Shard, phrases: Phrases, ids: list, slack: int) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for item, n, starts, exact in matches(shard, phrases, slack):
        doc = np.searchsorted(shard.begins, np.maximum(starts + slack, 0), "right") - 1
        spread = slack * ~exact
        start = np.maximum(starts - shard.begins[doc] - spread, 0)
        end = np.minimum(starts - shard.begins[doc] + n + spread, shard.counts[doc])
        for column, values in zip(columns, (doc, np.full(len(doc), item), start, end, exact), strict=True):
            column.append(values)
    doc, item, start, end, exact = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    order = np.lexsort((end, start, item, doc))
    hits = pa.StructArray.from_arrays(
        [
            pa.array([ids[i] for i in item[order].tolist()], pa.string()),
            pa.array(start[order], pa.int32()),
            pa.array(end[order], pa.int32()),
            pa.array(exact[order].astype(bool)),
        ],
        ["item", "start", "end", "exact"],
    )
    bounds = np.searchsorted(doc[order], np.arange(len(rows) + 1))
    return pa.RecordBatch.from_arrays(
        [
            rows,
            pa.array(np.full(len(rows), number), pa.int64()),
            pa.array(np.arange(len(rows)), pa.int64()),
            pa.array(shard.counts, pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), hits),
        ],
        ["row", "shard", "place", "n_words", "hits"],
    )


def _covered_words(hits: pa.Array) -> pa.Array:
    """Positions that at least one hit covers."""
    starts, ends = (hits.values.field(f).to_numpy() for f in ("start", "end"))
    bounds = hits.offsets.to_numpy()
    return pa.array([_covered(starts[a:b], ends[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())


def _covered(starts: np.ndarray, ends: np.ndarray) -> int:
    if not len(starts):
        return 0
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order].astype(np.int64), np.maximum.accumulate(ends[order]).astype(np.int64)
    return int((ends - np.maximum(starts, np.concatenate((starts[:1], ends[:-1])))).clip(0).sum())
