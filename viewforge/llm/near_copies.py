"""Near duplicates by improved consistent weighted sampling (Ioffe, ICDM 2010) over TF-IDF word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.llm.components import components, sizes
from viewforge.llm.frames import packed, quoted, ready, shared_table, sieved, text_key, unpacked
from viewforge.llm.words import BASE, mixed, word_blocks
from viewforge.operators.joins import SPREAD, group_for_join

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the similarity shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996.
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
#: Counters of the document-frequency sketch. Frequencies below about (shingles of a text / WIDTH) of all documents
#: look alike, at every size of the corpus.
DEPTH, WIDTH, CHUNK = 2, 1 << 21, 1 << 17
#: Texts of a family that are compared with each other in one task; larger families are dealt out in chunks of about this many.
FAMILY = 256
#: About so many texts of a large family are compared with all its chunks.
LEADERS = 32

_RANDOM = np.random.Generator(np.random.PCG64(2_010))
_BITS = 14
_SCALE = -np.log(_RANDOM.random((2, 1 << _BITS))).sum(0).astype(np.float32)  # Gamma(2, 1)
_INVERSE = (1 / _SCALE).astype(np.float32)
_LOG_C = np.log(-np.log(_RANDOM.random((2, 1 << _BITS))).sum(0)).astype(np.float32)
_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << _BITS) - 1)


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, distinct shingle hashes and how often each occurs, of every text with words."""
    for words in word_blocks(column):
        hashes, _, first = words.windows(SHINGLE, short=True)
        for i in np.flatnonzero(np.diff(first)):
            found, times = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
            yield words.rows.start + int(i), found, times


def _counters(found: np.ndarray) -> list[np.ndarray]:
    width = np.uint64(WIDTH - 1)
    return [((found * np.uint64(f)) >> np.uint64(40)) & width for f in (BASE, 0xD1342543DE82EF95)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's document frequencies, in chunks."""
    table = np.zeros((DEPTH, WIDTH), np.uint32)
    held, size = [], 0

    def fold() -> None:
        found = np.concatenate(held)
        for row, at in zip(table, _counters(found), strict=True):
            row += np.bincount(at.astype(np.int64), minlength=WIDTH).astype(np.uint32)

    for batch in batches:
        for _, found, _ in shingles(batch.column(0)):
            held.append(found)
            size += len(found)
            if size > WIDTH // 2:
                fold()
                held, size = [], 0
    if held:
        fold()
    group = TaskContext.get().partitionId() // 256
    for number, part in enumerate(table.reshape(-1, CHUNK)):
        if part.any():
            yield _chunk(number, group, part)


def _chunk(number: int, group: int, part: np.ndarray) -> pa.RecordBatch:
    body = pa.compress(part.astype("<u4").tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([group], pa.int32()), pa.array([body], pa.binary())], ["chunk", "group", "body"])


def _uncompressed(body: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, 4 * CHUNK, "zstd", asbytes=True), "<u4")


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint64)
    for body in table["body"]:
        total += _uncompressed(body.as_py())
    part = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.Table.from_batches([_chunk(table["chunk"][0].as_py(), table["group"][0].as_py(), part)])


class Weights:
    """TF-IDF weights from the sketch.

    The weight is the term frequency times 1 to 1.2, rising with the logarithm of the
    inverse document frequency. The plain logarithm would let texts with many copies
    drift apart, because what they share becomes cheap and what differs stays dear.
    """

    def __init__(self, chunks: dict[int, bytes], documents: int) -> None:
        table = np.zeros((DEPTH * WIDTH // CHUNK, CHUNK), np.uint32)
        for number, body in chunks.items():
            table[number] = _uncompressed(body)
        self.table, self.documents = table.reshape(DEPTH, WIDTH), max(documents, 2)

    def __call__(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        seen = np.minimum(*(row[at] for row, at in zip(self.table, _counters(found), strict=True)))
        rarity = np.log(self.documents / np.clip(seen, 1, self.documents)) / np.log(self.documents)
        return (times * (1 + rarity / 5)).astype(np.float32)


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent weighted samples, each as a 64-bit value for the shingle and its quantised weight."""
    best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    for i in range(0, len(found), 128):
        h, log = found[i : i + 128, None], np.log(weights[i : i + 128, None])
        m = h * _FACTORS
        at = (m >> np.uint64(50)).astype(np.int64)
        beta = ((m >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log * _INVERSE[at] + beta)
        a = _LOG_C[((m >> np.uint64(36)) & _LOW).astype(np.int64)] - _SCALE[at] * (t - beta + 1)
        rows = a.argmin(0)
        columns = np.arange(SAMPLES)
        value = mixed(h[rows, 0] ^ (t[rows, columns].astype(np.int64).astype(np.uint64) * np.uint64(BASE)))
        better = a[rows, columns] < best
        best, out = np.where(better, a[rows, columns], best), np.where(better, value, out)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in values.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(BASE) ^ row)
    return key


def _banded(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for row, found, times in shingles(batch.column(1)):
                rows.append(row)
                keys.append(bands(samples(found, weights.value(found, times))))
            flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(offsets, flat)], ["key", "bands"])

    return run


def _payload(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, heavy = [], [], []
            for row, found, times in shingles(batch.column(0)):
                rows.append(row)
                hashes.append(found.tobytes())
                heavy.append(weights.value(found, times).tobytes())
            kept = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(kept) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(hashes, pa.binary()), pa.array(heavy, pa.binary())], [*batch.schema.names[1:], "hashes", "weights"]
            )

    return run


def _links(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        columns = {n: table[n].to_pylist() for n in ("key", "family", "part", "asks", "hashes", "weights")}
        families: dict[bytes, list[int]] = {}
        for i, family in enumerate(columns["family"]):
            families.setdefault(family, []).append(i)
        links = [link for rows in families.values() for link in _linked(rows, columns, similarity)]
        return pa.table({n: pa.array([link[i] for link in links], pa.binary()) for i, n in enumerate("ab")})

    return run


def _linked(rows: list[int], columns: dict, similarity: float) -> list[tuple[bytes, bytes]]:
    """The parts that similar texts join, each linked to the smallest it is joined with.

    Every asking text is compared with all others at once, unless all are joined already.
    """
    hashes = [np.frombuffer(columns["hashes"][i], np.uint64) for i in rows]
    weights = np.concatenate([np.frombuffer(columns["weights"][i], np.float32) for i in rows]).astype(np.float64)
    ends = np.cumsum([len(h) for h in hashes])
    first = np.concatenate([[0], ends[:-1]])
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total, own = np.add.reduceat(weights, first), np.zeros(len(known))
    numbers: dict[bytes, int] = {}
    part = np.array([numbers.setdefault(columns["part"][i], len(numbers)) for i in rows])
    for i, row in enumerate(rows):
        if not columns["asks"][row] or (part == part[i]).all():
            continue
        mine = slice(first[i], ends[i])
        own[at[mine]] = weights[mine]
        common = np.add.reduceat(np.minimum(weights, own[at]), first)
        own[at[mine]] = 0
        for j in np.flatnonzero(common / (total + total[i] - common) >= similarity):
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
    least: dict[int, bytes] = {}
    names = {(columns["part"][i], int(p)) for i, p in zip(rows, part, strict=True)}
    for name, p in names:
        least[p] = min(name, least.get(p, name))
    return [(name, least[p]) for name, p in names if name != least[p]]


def _compared(known: DataFrame, dealt: DataFrame, weights, similarity: float) -> DataFrame:
    """Links between the parts that meet in a task; ``dealt`` holds ``key, family, part`` and the tasks of a text."""
    # Merged at every size, because the members grow with the corpus.
    texts = sieved(known.select("key", "text"), "key", dealt).join(dealt.hint("merge"), "key").dropDuplicates(["key"]).select("text", "key", "family", "part", "tasks")
    tasks = "array<struct<task: bigint, chunk: int, asks: boolean>>"
    payload = texts.mapInArrow(_payload(weights), f"key binary, family binary, part binary, tasks {tasks}, hashes binary, weights binary")
    spread = payload.withColumn("at", F.explode("tasks")).select("*", "at.*").drop("tasks", "at")
    return spread.groupBy("task", "chunk").applyInArrow(_links(similarity), "a binary, b binary")


def _unsettled(large: DataFrame, placed: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """What is left to compare in large families.

    Only texts in a bucket with texts of another part can have links that are not known
    yet. Of each family, those outside its largest part ask all of these, in blocks.
    """
    part = F.coalesce("root", "key").alias("part")
    parted = shared_table(large.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "family", part), "parts", rows)
    held = sieved(placed, "key", parted).join(parted, "key")
    mixed_bands = group_for_join(held, ["band"]).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").drop(SPREAD)
    keys = held.join(mixed_bands.select("band"), "band", "left_semi").select("key").distinct()
    counts = parted.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("family").agg(F.max(F.struct("n", "part"))["part"].alias("largest"))
    open_ = parted.join(keys, "key", "left_semi").join(largest, "family").select("key", "family", "part", (F.col("part") != F.col("largest")).alias("asks"))
    open_ = shared_table(open_, "open", rows)
    blocks = open_.groupBy("family").agg(
        F.ceil(F.count_if("asks") / FAMILY).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("chunks")
    )

    block, chunk = (F.pmod(F.xxhash64("key"), F.col(n)).cast("int") for n in ("blocks", "chunks"))
    asking = F.transform(F.expr("sequence(0, chunks - 1)"), lambda c: _task(c, True, block))
    asked = F.transform(F.expr("sequence(0, blocks - 1)"), lambda b: _task(chunk, False, b))
    tasks = F.when(F.col("asks"), F.concat(asking, asked)).otherwise(asked).alias("tasks")
    return open_.join(blocks, "family").select("key", "family", "part", tasks)


def _joined(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """``classes`` with the roots that ``parts`` joins."""
    every = classes.unionByName(parts.select("node", F.col("node").alias("root"))).distinct()
    whole = parts.select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return every.join(whole, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))


def _task(chunk: Column, asks: bool, *block: Column) -> Column:
    return F.struct(F.xxhash64("family", *block, chunk).alias("task"), chunk.alias("chunk"), F.lit(asks).alias("asks"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, class_size, chosen`` for every text key that has a copy or a near copy.

    The key is that of ``text_key``; ``class_id`` is the smallest id in the class,
    ``class_size`` its number of rows, and ``chosen`` marks the key that holds that id.
    """
    spark = docs.sparkSession
    ready(spark)
    known = docs.where(quoted(text).isNotNull()).select(text_key(quoted(text)).alias("key"), quoted(id).alias("id"), quoted(text).alias("text"))
    parts = known.select("text").mapInArrow(_sketch, "chunk int, group int, body binary")
    for by in (["chunk", "group"], ["chunk"]):
        parts = parts.groupBy(*by).applyInArrow(_added, "chunk int, group int, body binary")
    chunks = {r["chunk"]: r["body"] for r in parts.collect()}  # DEPTH * WIDTH counters, whatever the corpus
    rows = known.count()
    weights = spark.sparkContext.broadcast(Weights(chunks, rows))

    banded = known.select("key", "text").mapInArrow(_banded(weights), "key binary, bands array<long>").dropDuplicates(["key"])
    banded = shared_table(banded, "bands", rows)
    placed = banded.select("key", F.explode("bands").alias("band"))
    hubs = group_for_join(placed, ["band"]).agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop(SPREAD, "n")
    hubs = shared_table(hubs, "hubs", rows)
    # All hubs of a text are linked to the smallest of them, so that a text adds one link to a family instead of one a band.
    named = sieved(placed, "band", hubs).join(hubs, "band").groupBy("key").agg(F.collect_set("hub").alias("hubs")).withColumn("b", F.array_min("hubs"))
    stars = named.select(F.explode(F.array_union("hubs", F.array("key"))).alias("a"), "b").where("a <> b").distinct()
    families = components(shared_table(stars, "stars", rows), rows)

    chunks = F.ceil(F.col("size") / FAMILY).cast("int").alias("chunks")
    sized = families.join(sizes(families), "root").select(F.col("node").alias("key"), F.col("root").alias("family"), chunks)
    members = shared_table(sized, "families", rows)
    batches = max(1, members.count() // (2 * FAMILY))
    leads = F.pmod(F.xxhash64("key", "family"), F.col("chunks") * max(1, FAMILY // LEADERS)) == 0
    own = F.array(F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    alone = F.struct(F.pmod(F.xxhash64("family"), F.lit(batches)).alias("task"), F.lit(-1).alias("chunk"), F.lit(True).alias("asks"))
    several = F.transform(F.when(leads, F.expr("sequence(0, chunks - 1)")).otherwise(own), lambda chunk: _task(chunk, True))
    tasks = F.when(F.col("chunks") == 1, F.array(alone)).otherwise(several).alias("tasks")
    dealt = members.select("key", "family", F.col("key").alias("part"), tasks)
    classes = components(shared_table(_compared(known, dealt, weights, similarity), "links"), rows)
    large = members.where("chunks > 1").select("key", "family")
    if not large.isEmpty():
        again = shared_table(_compared(known, _unsettled(large, placed, classes, rows), weights, similarity), "links")
        if not again.isEmpty():
            classes = _joined(classes, components(again, rows))

    copies = group_for_join(known, ["key"]).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).drop(SPREAD)
    roots = classes.withColumnRenamed("node", "key")
    rooted = shared_table(
        copies.join(roots, "key", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "key")), "classes", rows
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    whole = group_for_join(rooted, ["root"]).agg(first, F.sum("n").alias("class_size")).drop(SPREAD)
    return rooted.join(whole, "root").select(
        "key", F.col("first.id").alias("class_id"), "class_size", (F.col("key") == F.col("first.key")).alias("chosen")
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``class_id`` (smallest id of its class) and ``class_size``; alone, a document is its own class.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles
    is at least ``similarity``; classes are the connected texts. A text of fewer
    words, but not none, is one shingle. Equal texts are one class, empty ones included; a
    null text is alone, and so is its class id. Columns named like a result column are
    replaced; an empty table gives an empty result.

    Document frequencies come from a count-min sketch over all texts. Candidates
    share a band of samples; each bucket only names its smallest text, and the texts so
    connected form a family. Within a family all pairs not yet connected are verified, and
    only connecting links leave a task. A family of more than ``FAMILY`` texts is dealt out
    in chunks, each with the family's leaders; after that only texts that share a bucket
    with a text of another part are compared further, block by block. So the work follows
    the number of copies unless large parts of a family are candidates but not similar.
    """
    classes = near_classes(docs, similarity, id, text)
    rows = packed(docs, key=text_key(quoted(text))).join(classes, "key", "left")
    out = rows.select(
        "row",
        F.coalesce("class_id", F.col("row").getField(id)).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )
    return unpacked(out, docs.columns, ["class_id", "class_size"])


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: the one with the smallest id. Null texts all stay; of equal rows one stays."""
    classes = near_classes(docs, similarity, id, text)
    rows = packed(docs, key=text_key(quoted(text))).join(classes, "key", "left")
    alone = rows.where("class_id IS NULL AND chosen IS NULL").select("row")
    own = F.col("row").getField(id).eqNullSafe(F.col("class_id"))
    chosen = rows.where(F.col("chosen") & own).dropDuplicates(["key"]).select("row")
    return unpacked(alone.unionByName(chosen), docs.columns, [])
