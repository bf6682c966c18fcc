"""Ranked lexical search: impact vectors in buckets by length, pruned by bounds, survivors scored in integers.

A document is the vector of its impacts ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``
over the terms of the stated items; an item is the vector of its term counts, and the
score is their product. Vectors are laid out by falling length in buckets, after LEMP
(Teflioudi, Gemulla, Mykytiuk: Exact and approximate maximum inner product search with
LEMP, TODS 2016). With the score that the k-th best document of an item has so far,

* a bucket is left out when the item's length times that of the longest vector is lower
  (Cauchy-Schwarz), or the sum of the largest impacts per coordinate is;
* inside, only documents in the lists of the focus coordinates are looked at: those
  without which the largest impacts of the others cannot reach the score;
* of these, documents go whose sum over the focus and a bound of the rest is lower.

Bounds are floating-point numbers with a margin, scores 64-bit integers, so the result is
that of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewforge.llm.frames import quoted, ready, shared_table, shuffle_width
from viewforge.llm.words import ALPHANUMERIC, LOWER, word_blocks

#: Bytes of item texts that are searched for at a time; that bounds what is sent to every task.
QUERY_BYTES = 4 << 20
#: Terms and documents of one bucket; a longer vector makes a bucket of its own.
BUCKET_TERMS, BUCKET_ROWS = 1 << 20, 1 << 16
#: Terms that one task sorts.
TASK_TERMS = 1 << 23
#: What a bound is raised by against rounding.
MARGIN = 1 + 1e-9
_TOTALS = {"documents": -1, "terms": -2}


@dataclass
class Items:
    """Some items as sparse vectors: positions in the vocabulary and counts."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, ids: Sequence, texts: Sequence[str | None]) -> Items:
        found = [np.zeros(0, np.uint64)] * len(ids)
        for block in word_blocks(pa.array(texts, pa.string()), ALPHANUMERIC, LOWER):
            for row, a, b in zip(range(block.rows.start, block.rows.stop), block.first[:-1], block.first[1:], strict=True):
                found[row] = block.hashes[a:b]
        vocabulary = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        pairs = [np.unique(np.searchsorted(vocabulary, words), return_counts=True) for words in found]
        return cls(list(ids), vocabulary, [t for t, _ in pairs], [c for _, c in pairs])


def _counted(items: Broadcast):
    """Per document: its number of terms, and positions and counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        for batch in batches:
            for words in word_blocks(batch.column(1), ALPHANUMERIC, LOWER):
                n, size = len(words.counts), max(1, len(vocabulary))
                at = np.minimum(np.searchsorted(vocabulary, words.hashes), size - 1)
                known = vocabulary[at] == words.hashes if len(vocabulary) else np.zeros(len(at), bool)
                pairs, tf = np.unique(np.repeat(np.arange(n), words.counts)[known] * size + at[known], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(n + 1) * size)
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
                    for values, kind in ((pairs % size, pa.int32()), (tf, pa.int64()))
                ]
                own = batch.column(0).slice(words.rows.start, n)
                yield pa.RecordBatch.from_arrays([own, pa.array(words.counts, pa.int64()), *lists], ["doc", "n", "terms", "tf"])

    return run


def _frequencies(width: int):
    """Documents with each term, and under negative numbers the documents with terms and their terms, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=width)
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        held = np.flatnonzero(df)
        keys = np.append(held, list(_TOTALS.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array(np.append(df[held], [documents, terms]), pa.int64())], ["term", "n"]
        )

    return run


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``(10**9 * tf) div (1000 * tf + 8 * m)`` with ``m = 25 + (75 * n * documents) div terms``, exact for every ``n``."""
    m = np.array([25 + 75 * x * documents // terms for x in n.tolist()], object) if len(n) and 75 * documents * int(n.max()) >> 62 else None
    if m is None:
        m = 25 + 75 * documents * n // terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)
    return (1_000_000_000 * tf.astype(object) // (1000 * tf.astype(object) + 8 * m)).astype(np.int64)


def _vectors(weights: Broadcast, documents: int, terms: int):
    """Vectors of documents and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            doc, n, positions, tf = batch.columns
            bounds = positions.offsets.to_numpy() - positions.offsets[0].as_py()
            held, rows = positions.flatten().to_numpy(), np.repeat(np.arange(len(doc)), np.diff(bounds))
            x = w[held] * impacts(tf.flatten().to_numpy(), n.to_numpy()[rows], documents, terms)
            length = np.sqrt(np.bincount(rows, x.astype(float) ** 2, len(doc)))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (held, x)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(length), *lists], ["doc", "length", "terms", "impacts"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of consecutive vectors, as lists by term: sorted terms, ends of their lists, rows and impacts."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def bucket() -> pa.RecordBatch:
        docs, lengths, positions, values = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
        counts = np.diff(positions.offsets.to_numpy())
        term, x, row = positions.flatten().to_numpy(), values.flatten().to_numpy(), np.repeat(np.arange(len(docs)), counts)
        order = np.argsort(term, kind="stable")
        names, ends = np.unique(term[order], return_index=True)
        parts = [names.astype("<i4"), np.append(ends[1:], len(term)).astype("<u4"), row[order].astype("<u4"), x[order].astype("<i8")]
        length = lengths.to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([float(length.max())]),
                pa.ListArray.from_arrays([0, len(docs)], docs),
                *(pa.array([p.tobytes()], pa.binary()) for p in (length.astype("<f8"), *parts)),
            ],
            BUCKET,
        )

    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            fits = int(np.searchsorted(ends, before + BUCKET_TERMS - size, "right")) - start
            take = min(batch.num_rows - start, BUCKET_ROWS - rows, max(fits, 0 if held else 1))
            if take:
                held.append(batch.slice(start, take))
                rows, size, start = rows + take, size + int(ends[start + take - 1]) - before, start + take
            if start < batch.num_rows:
                yield bucket()
                held, rows, size = [], 0, 0
    if held:
        yield bucket()


BUCKET = ["longest", "docs", "lengths", "terms", "ends", "rows", "impacts"]
_BUCKET_DDL = "longest double, docs array<long>, lengths binary, terms binary, ends binary, rows binary, impacts binary"


class Bucket:
    """One bucket's lists, looked at in place."""

    def __init__(self, longest: float, lengths: bytes, terms: bytes, ends: bytes, rows: bytes, impacts: bytes) -> None:
        self.longest, self.lengths = longest, np.frombuffer(lengths, "<f8")
        self.terms, ends = np.frombuffer(terms, "<i4"), np.frombuffer(ends, "<u4").astype(np.int64)
        self.begins, self.ends = np.concatenate(([0], ends[:-1])), ends
        self.rows, self.impacts = np.frombuffer(rows, "<u4"), np.frombuffer(impacts, "<i8")
        self.largest = np.maximum.reduceat(self.impacts, self.begins) if len(self.impacts) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score ``least`` or more against the item, and their scores; others may be among them, none is missed."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, counts = at[here], counts[here].astype(np.int64)
        if not len(at) or np.linalg.norm(counts) * self.longest * MARGIN < least:
            return none
        most = counts * self.largest[at]
        order = np.argsort(-most, kind="stable")
        at, counts, most = at[order], counts[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        if rest[0] < least:
            return none
        focus = int(np.argmax(rest < least))
        score, squares = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths))
        for i, count in zip(at[:focus], counts[:focus], strict=True):
            part = slice(self.begins[i], self.ends[i])
            score[self.rows[part]] += count * self.impacts[part]
            squares[self.rows[part]] += self.impacts[part].astype(float) ** 2
        found = np.flatnonzero(score)
        left = np.linalg.norm(counts[focus:]) * np.sqrt(np.maximum((self.lengths[found] * MARGIN) ** 2 - squares[found], 0))
        found = found[score[found] + np.minimum(left * MARGIN, rest[focus]) >= least]
        exact = score[found]
        for i, count in zip(at[focus:], counts[focus:], strict=True):
            part = slice(self.begins[i], self.ends[i])
            place = np.minimum(np.searchsorted(self.rows[part], found), part.stop - part.start - 1)
            exact += np.where(self.rows[part][place] == found, count * self.impacts[part][place], 0)
        return found, exact


class Best:
    """The best documents of one item so far; of equal scores the smaller ids, null first."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, least
        self.scores, self.ids, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        scores = np.concatenate((self.scores, scores))
        named = np.concatenate((self.named, ids.is_valid().to_numpy(False)))
        ids = np.concatenate((self.ids, ids.fill_null(0).to_numpy()))
        order = np.lexsort((ids, named, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _searched(items: Broadcast, k: int, least: Broadcast):
    """The best documents per item over the buckets of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        best = [Best(k, start) for start in least.value]
        for batch in batches:
            for longest, docs, *parts in zip(*batch.columns, strict=True):
                bucket = Bucket(longest.as_py(), *(p.as_py() for p in parts))
                for one, terms, counts in zip(best, own.terms, own.counts, strict=True):
                    rows, scores = bucket.search(terms, counts, one.least)
                    if len(rows):
                        one.add(scores, docs.values.take(pa.array(rows)))
        item = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=~np.concatenate([b.named for b in best]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), ids, pa.array(np.concatenate([b.scores for b in best]))], ["item", "doc", "score"]
        )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item by their whole texts.

    Terms are runs of ASCII letters, digits and everything beyond ASCII, with only A-Z
    lower-cased. A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; the
    score sums weight times impact over the item's terms, repeats included. Scores are
    above 0; equal ones rank by document id, null first. Null and empty texts have no
    terms. Repeated documents count and rank each; repeated items are searched for each,
    so their ranks come repeatedly. Empty tables give no rows; other columns are not read.
    Id columns whose names clash with the result's are returned as ``item_id`` and ``doc_id``.

    Terms are compared by 64-bit hashes. Items are taken in blocks of about
    ``QUERY_BYTES`` bytes, whose vectors every task gets; each block reads the texts once.
    Vectors are written to the shared folder, range-sorted by length and cut into buckets
    of bounded size. The first bucket gives every item its first score to beat; a task
    keeps ``k`` documents per item, whatever its buckets hold.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(quoted(doc_id).cast("long").alias("doc"), quoted(text).alias("text"))
    wanted = items.select(quoted(item_id).alias("id"), quoted(item_text).alias("text")).where("text IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)))).first()[0] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    results = []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        own = Items.of([r["id"] for r in rows], [r["text"] for r in rows])
        if len(own.vocabulary):
            found = _search_block(texts, own, k)
            if found is not None:
                names = spark.createDataFrame(list(enumerate(own.ids)), f"item long, id {wanted.schema['id'].dataType.simpleString()}")
                results.append(found.join(F.broadcast(names), "item").select("id", "rank", "doc", "score"))
    no_id = F.lit(None).cast(wanted.schema["id"].dataType).alias("id")
    out = texts.where("false").select(no_id, F.lit(0).alias("rank"), "doc", F.lit(0).cast("long").alias("score"))
    for more in results:
        out = out.unionByName(more)
    taken = {"rank", "score"}
    doc_name = doc_id if doc_id not in taken else "doc_id"
    item_name = item_id if item_id not in taken | {doc_name} else "item_id"
    return out.select(F.col("id").alias(item_name), "rank", F.col("doc").alias(doc_name), "score")


def _search_block(texts: DataFrame, own: Items, k: int) -> DataFrame | None:
    spark = texts.sparkSession
    context = spark.sparkContext
    items = context.broadcast(own)
    counted = shared_table(texts.mapInArrow(_counted(items), "doc long, n long, terms array<int>, tf array<long>"), "term-counts")
    sums = counted.select("n", "terms").mapInArrow(_frequencies(len(own.vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = dict(map(tuple, sums.collect()))
    documents, terms = (known.pop(key, 0) for key in _TOTALS.values())
    if not known:
        return None
    weights = np.zeros(len(own.vocabulary), np.int64)
    for term, df in known.items():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    vectors = counted.where("size(terms) > 0").mapInArrow(
        _vectors(context.broadcast(weights), documents, terms), "doc long, length double, terms array<int>, impacts array<long>"
    )
    width = max(shuffle_width(spark), math.ceil(sum(known.values()) / TASK_TERMS))
    falling = vectors.where("length > 0").withColumn("number", F.monotonically_increasing_id())
    laid = falling.repartitionByRange(width, F.desc("length"), "number").sortWithinPartitions(F.desc("length"), "number")
    buckets = shared_table(laid.drop("number").mapInArrow(_buckets, _BUCKET_DDL), "buckets")
    longest = buckets.agg(F.max("longest")).first()[0]
    if longest is None:
        return None
    result = "item long, doc long, score long"
    start = context.broadcast([1] * len(own.ids))
    first = shared_table(_ranked(buckets.where(F.col("longest") == longest).mapInArrow(_searched(items, k, start), result), k), "first")
    beaten = dict(map(tuple, first.where(F.col("rank") == k).select("item", "score").collect()))
    least = context.broadcast([beaten.get(i, 1) for i in range(len(own.ids))])
    rest = buckets.where(F.col("longest") < longest).mapInArrow(_searched(items, k, least), result)
    return _ranked(first.select("item", "doc", "score").unionByName(rest), k)


#: The same ranking in SQL over ``documents`` and ``benchmark``.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized),
items AS (
  SELECT row_number() OVER () AS i, item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS q FROM items GROUP BY ALL),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, total GROUP BY term, nd),
scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term), total GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
