"""The trie of conversation prefixes, from range minima over the sorted conversations.

Conversations are sorted by the digests of their turns; beside each stands how many
turns it shares with the one before. The members of a prefix of ``d`` turns are then the
longest stretch around any of them in which at least ``d`` turns are shared, and two
binary searches over a sparse table of range minima find its ends, for every prefix on
its own. Counts, smallest members, leaves and saved words are differences of prefix
sums and range minima over the stretch.

The sorted rows lie in shards of bounded size. A second sparse table over one number per
shard and shard border finds where a stretch that crosses borders begins; its parts are
added up by that place. A conversation longer than ``chunk`` turns is cut: each further
piece is sorted among the pieces whose conversations agree up to there, so no
conversation and no group of copies has to fit one row, one shard or one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewforge.llm.frames import WORD, quoted, ready, shared_table, shuffle_width
from viewforge.llm.words import buffers
from viewforge.operators.joins import SPREAD, group_for_join

#: Turns of one row at most, and of one shard unless a single row has more.
CHUNK, SHARD_TURNS = 1 << 12, 1 << 18
#: Rows of the turn table that one range partition takes.
TASK_ROWS = 1 << 22
#: Characters of a list of ids that go into one row.
PIECE = 1 << 14
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ID = ["shard", "place"]


# ---------------------------------------------------------------- turns in order


def ordered_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, pos, digest, words`` of every turn, numbered from 0 within its conversation.

    Turns are ordered by ``turn``, null first, and of equal ones by their digest; repeated
    rows are turns each. Null roles and texts are empty. Rows without a conversation id
    belong to none and are left out. Other columns are not read.

    The rows are range-sorted, so a conversation with most of all turns is numbered by
    many tasks; each partition then learns how many rows of its first conversation came
    before it, from one row per partition.
    """
    spark = conversations.sparkSession
    ready(spark)
    said, content = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.where(quoted(conv_id).isNotNull()).select(
        quoted(conv_id).cast("long").alias("conv"),
        quoted(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, content))).alias("digest"),
        F.regexp_count(content, F.lit(WORD)).alias("words"),
        F.monotonically_increasing_id().alias("number"),
    )
    stored = shared_table(turns, "turns")
    order = ["conv", F.asc_nulls_first("turn"), "digest", "number"]
    width = max(shuffle_width(spark), stored.count() // TASK_ROWS)
    laid = stored.repartitionByRange(width, *order).sortWithinPartitions(*order).select("conv", "digest", "words")
    counted = shared_table(laid.mapInArrow(_counted, "conv long, digest binary, words int, part int, pos long"), "positions")
    ends = counted.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos")).alias("end")).collect()
    carries, last, so_far = [], None, 0
    for part in sorted(ends, key=lambda r: r["part"]):
        before = so_far if part["first"] == last else 0
        if before:
            carries.append((part["part"], last, before))
        last, so_far = part["end"]["conv"], part["end"]["pos"] + 1 + (before if part["end"]["conv"] == part["first"] else 0)
    carried = F.broadcast(spark.createDataFrame(carries, "part int, conv long, before long"))
    joined = counted.join(carried, ["part", "conv"], "left")
    return joined.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, so_far = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        begins = np.concatenate(([-so_far if conv[0] == last else 0], starts[1:]))
        pos = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(starts, len(conv))))
        last, so_far = conv[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(pos)], ["conv", "digest", "words", "part", "pos"]
        )


def spliced_turns(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their block: ``conv, depth, digest, words``, and ids without turns.

    Conversation ``c`` takes the first ``h = crc32(c) % most`` turns of ``c - c % block``
    (all if it has fewer, none if it is absent) and then its own after its first ``h``.
    """
    stored = shared_table(turns, "ordered")
    sizes = group_for_join(stored, ["conv"]).agg(F.count(F.lit(1)).alias("n")).drop(SPREAD)
    sizes = shared_table(sizes, "sizes")
    wanted = sizes.select(
        "conv", "n", F.expr(f"conv - conv % {block}").alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    )
    bases = sizes.where(f"conv % {block} = 0").select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = wanted.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = shared_table(plan, "splices")
    own = stored.join(plan.select("conv", "h", "k"), "conv").where("pos >= h").selectExpr("conv", "k + pos - h + 1 AS depth", "digest", "words")
    heads = stored.where(F.col("pos") < most - 1).selectExpr("conv AS base", "pos", "digest", "words")
    taken = plan.where("k > 0").select("conv", "base", "k").join(heads, "base").where("pos < k")
    out = own.unionByName(taken.selectExpr("conv", "pos + 1 AS depth", "digest", "words"))
    return out, plan.where("k + greatest(n - h, 0) = 0").select("conv")


# ---------------------------------------------------------------- sorted shards


def _chunks(turns: DataFrame, chunk: int) -> tuple[DataFrame, bool]:
    """Rows of up to ``chunk`` turns: level, fingerprint of all before, digests, words, words before, whether more follow."""
    rows = turns.select("conv", F.expr(f"(depth - 1) div {chunk}").alias("level"), F.struct("depth", "digest", "words").alias("turn"))
    lists = rows.groupBy("conv", "level").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    key, words = F.col("turns.digest"), F.col("turns.words")
    stored = shared_table(lists.select("conv", "level", key.alias("key"), words.alias("words")), "chunks")
    deep = bool(stored.agg(F.max("level")).first()[0])
    plain = stored.select("conv", "level", "key", "words", *(F.lit(v).cast("long").alias(n) for n, v in (("g1", 0), ("g2", 0), ("before", 0))))
    if not deep:
        return plain.withColumn("more", F.lit(False)), False
    long = stored.where("level > 0").select("conv").distinct()
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)
    light = stored.join(long, "conv", "left_semi").select(
        "conv", "level", F.xxhash64("level", "key").alias("x1"), F.xxhash64("key", "level", F.lit(7)).alias("x2"), total.alias("total")
    )
    order = Window.partitionBy("conv").orderBy("level")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = light.select(
        "conv",
        "level",
        *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(g) for x, g in (("x1", "g1"), ("x2", "g2"))),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"),
        F.lead("level").over(order).isNotNull().alias("more"),
    )
    short = plain.join(long, "conv", "left_anti").withColumn("more", F.lit(False))
    return short.unionByName(stored.join(placed, ["conv", "level"])), True


_SHARD = ["part", "seq", "first", "last", "inner", "deep", "convs", "levels", "lengths", "digests", "words", "before", "more", "shared"]
_SHARD_DDL = (
    "part int, seq int, first binary, last binary, inner long, deep boolean, convs binary, levels binary, lengths binary, "
    "digests binary, words binary, before binary, more binary, shared binary"
)
#: Shared turns of two rows of different groups, and of no rows at all.
APART, ALL = -1, np.iinfo(np.int64).max


def _shared(digests: np.ndarray, begins: np.ndarray, lengths: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Leading turns that each row has in common with the one before; 0 for the first and where not ``alike``."""
    out, least = np.zeros(len(lengths), np.int64), np.minimum(lengths, np.concatenate(([0], lengths[:-1])))
    rows, depth = np.flatnonzero(alike & (least > 0)), 0
    while len(rows):
        rows = rows[(digests[begins[rows] + depth] == digests[begins[rows - 1] + depth]).all(1)]
        depth += 1
        out[rows] = depth
        rows = rows[least[rows] > depth]
    return out


def _shards(chunk: int):
    """Shards of consecutive sorted rows, each row with the turns it shares with the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            level, g1, g2, conv, before, more, key, words = (pa.concat_arrays([b.column(i) for b in held]) for i in range(8))
            group = np.stack([c.to_numpy().astype(np.int64) for c in (level, g1, g2)], 1)
            lengths = np.diff(key.offsets.to_numpy()).astype(np.int64)
            data, bounds = buffers(key.flatten())
            digests = data[bounds[0] : bounds[-1]].view("<u8").reshape(-1, 2)
            alike = np.concatenate(([False], (group[1:] == group[:-1]).all(1)))
            shared = np.where(alike, group[:, 0] * chunk + _shared(digests, np.cumsum(lengths) - lengths, lengths, alike), APART)
            own = (0, digests[: lengths[0]]), (-1, digests[len(digests) - lengths[-1] :])
            edge = [group[i].astype("<i8").tobytes() + d.tobytes() for i, d in own]
            deep = bool(group[:, 0].any() or more.to_numpy(False).any())
            parts = [conv.to_numpy().astype("<i8"), group[:, 0].astype("<i8"), lengths.astype("<u4"), digests]
            parts += [words.flatten().to_numpy().astype("<u4"), before.to_numpy().astype("<i8"), more.to_numpy(False).astype("u1"), shared.astype("<i8")]
            inner = int(shared[1:].min()) if len(shared) > 1 else ALL
            values = [part, seq, *edge, inner, deep, *(p.tobytes() for p in parts)]
            schema = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), *[pa.binary()] * len(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema, strict=True)], _SHARD)

        for batch in batches:
            ends, start = np.cumsum(np.diff(batch.column(6).offsets.to_numpy())), 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                take = int(np.searchsorted(ends, before + SHARD_TURNS - size, "right")) - start
                take = min(max(take, 0 if held else 1), batch.num_rows - start)
                if take:
                    held.append(batch.slice(start, take))
                    size, start = size + int(ends[start + take - 1]) - before, start + take
                if start < batch.num_rows:
                    yield shard()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield shard()

    return run


def _borders(chunk: int):
    """Turns that the first row of a shard shares with the last row of the shard before."""

    def shared(last: bytes, first: bytes) -> int:
        if last[:24] != first[:24]:
            return APART
        a, b = (np.frombuffer(x[24:], "<u8").reshape(-1, 2) for x in (last, first))
        n = min(len(a), len(b))
        differ = np.flatnonzero((a[:n] != b[:n]).any(1))
        return int(np.frombuffer(first[:8], "<i8")[0]) * chunk + (int(differ[0]) if len(differ) else n)

    def run(last: pa.Array, first: pa.Array) -> pa.Array:
        return pa.array([shared(a, b) for a, b in zip(last.to_pylist(), first.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "long")


# ---------------------------------------------------------------- range minima


class Minima:
    """A sparse table: minima of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place before which, from the one after ``at`` on, no value is below ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(at + (1 << k) < len(self.levels[0]))
            ok = ok[self.levels[k][at[ok] + 1] >= least[ok]]
            at[ok] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place after which, up to ``at``, no value is below ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero(at - (1 << k) >= 0)
            ok = ok[self.levels[k][at[ok] - (1 << k) + 1] >= least[ok]]
            at[ok] -= 1 << k
        return at

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minimum from ``a`` to ``b``, both included."""
        out = np.empty(len(a), self.levels[0].dtype)
        k = np.frexp((b - a + 1).astype(float))[1] - 1
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            values = self.levels[level]
            out[own] = np.minimum(values[a[own]], values[b[own] - (1 << int(level)) + 1])
        return out


class Borders:
    """One number per shard and border, which tells where stretches that cross borders begin."""

    def __init__(self, border: np.ndarray, inner: np.ndarray) -> None:
        self.border = np.append(border, APART)
        self.minima = Minima(np.minimum(border, inner))

    def home(self, shard: int, depths: np.ndarray) -> np.ndarray:
        """The shard in which the stretch of each depth begins that comes into this one from the left."""
        return self.minima.left(np.full(len(depths), shard - 1), depths)


class Shard:
    """One shard's rows, candidates (a row and each depth at which its prefix first occurs here) and their stretches."""

    def __init__(self, number: int, parts: Sequence[bytes], borders: Borders, chunk: int) -> None:
        convs, levels, lengths, _, words, before, more, shared = parts
        self.number, self.borders = number, borders
        self.convs, self.level = np.frombuffer(convs, "<i8"), np.frombuffer(levels, "<i8")
        self.base, lengths = self.level * chunk, np.frombuffer(lengths, "<u4").astype(np.int64)
        self.end, self.more = self.base + lengths, np.frombuffer(more, "u1").astype(bool)
        self.shared = np.frombuffer(shared, "<i8").copy()
        self.shared[0], after = borders.border[number], borders.border[number + 1]
        self.minima, self.smallest = Minima(self.shared), Minima(self.convs)
        n = len(self.convs)
        # Words of a row's conversation up to each depth of the row.
        self.words = np.concatenate(([0], np.cumsum(np.frombuffer(words, "<u4").astype(np.int64))))
        self.word0 = np.cumsum(lengths) - lengths
        self.before = np.frombuffer(before, "<i8")
        self.start = np.maximum(self.shared - self.base, 0)
        self.start[0] = 0
        new = lengths - self.start
        self.offset = np.cumsum(new) - new
        self.row = np.repeat(np.arange(n), new)
        self.depth = np.arange(len(self.row)) - self.offset[self.row] + self.base[self.row] + self.start[self.row] + 1
        self.a, self.b = self.minima.left(self.row, self.depth), self.minima.right(self.row, self.depth)
        self.enters = (self.a == 0) & (self.shared[0] >= self.depth)
        self.crosses = self.enters | ((self.b == n - 1) & (after >= self.depth))
        self.conv = self.smallest.between(self.a, self.b)
        follows = np.append(self.shared[1:], after)
        self.leaf = ~self.more & (follows < self.end)

    def words_to(self, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Words of the first ``depths`` turns of each row's conversation."""
        at = self.word0[rows]
        return self.before[rows] + self.words[at + np.maximum(depths - self.base[rows], 0)] - self.words[at]

    def candidate(self, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The candidate that stands for each row's prefix of that depth."""
        first = self.minima.left(rows, depths)
        return self.offset[first] + depths - self.base[first] - self.start[first] - 1

    def ids(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place that stand for each candidate's prefix in all shards."""
        shard, place = np.full(len(candidates), self.number), candidates.copy()
        enters, crosses = self.enters[candidates], self.crosses[candidates]
        place[crosses] = -self.depth[candidates[crosses]]
        if enters.any():
            shard[enters] = self.borders.home(self.number, self.depth[candidates[enters]])
        return shard, place

    def ending(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates at which conversations end, and the rows of these, from and to."""
        same = (self.shared == self.end) & ~self.more
        same[1:] &= self.end[1:] == self.end[:-1]
        same[0] = False
        begins = np.flatnonzero(~same)
        stops = np.append(begins[1:], len(same))
        ends = ~self.more[begins]
        begins, stops = begins[ends], stops[ends]
        return self.candidate(begins, self.end[begins]), begins, stops

    def parts(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """One row per prefix, as far as this shard holds its members; beside the values, which are known."""
        n, row = len(self.row), self.row
        first_new = np.arange(n) == self.offset[row]
        parent, inside = np.arange(n) - 1, ~first_new
        low = np.flatnonzero(first_new & (self.start[row] > 0))
        parent[low], inside[low] = self.candidate(row[low], self.depth[low] - 1), True
        children = np.bincount(parent[inside & ~self.enters], minlength=n)
        leaves = np.concatenate(([0], np.cumsum(self.leaf)))
        rows = np.arange(len(self.convs))
        common = np.concatenate(([0], np.cumsum(np.where(self.shared > 0, self.words_to(rows, np.maximum(self.shared, 0)), 0))))
        shard, place = self.ids(np.arange(n))
        up = np.where(inside, parent, 0)
        up_shard, up_place = self.ids(up)
        near = inside & ~self.crosses[up]
        return [
            (shard, None),
            (place, None),
            (self.depth, None),
            (self.conv, None),
            (self.b - self.a + 1, None),
            (children, None),
            (leaves[self.b + 1] - leaves[self.a], None),
            (common[self.b + 1] - common[self.a + ~self.enters], None),
            (self.words_to(row, self.depth - 1), None),
            (self.crosses, None),
            (self.conv[up], near),
            (up_shard, inside & ~near),
            (up_place, inside & ~near),
        ]


_PART = ["shard", "place", "depth", "conv", "n", "children", "leaves", "common", "before", "crosses", "parent", "up_shard", "up_place", "at", "ends"]
_PART_DDL = ", ".join(f"{c} {'boolean' if c == 'crosses' else 'string' if c == 'ends' else 'long'}" for c in _PART)


def _on_shards(borders: Broadcast, chunk: int, rows):
    """``rows`` of each shard as record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in zip(*batch.columns, strict=True):
                yield rows(Shard(number.as_py(), [p.as_py() for p in parts], borders.value, chunk))

    return run


def _masked(columns: list[tuple[np.ndarray, np.ndarray | None]]) -> list[pa.Array]:
    return [pa.array(v, mask=None if known is None else ~known) for v, known in columns]


def _part_rows(shard: Shard) -> pa.RecordBatch:
    texts: list[str | None] = [None] * len(shard.row)
    for candidate, a, b in zip(*(x.tolist() for x in shard.ending()), strict=True):
        texts[candidate] = ",".join(map(str, shard.convs[a:b].tolist()))
    at = pa.array(np.full(len(texts), shard.number), pa.int64())
    return pa.RecordBatch.from_arrays([*_masked(shard.parts()), at, pa.array(texts, pa.string())], _PART)


def _deep_rows(shard: Shard) -> pa.RecordBatch:
    """Of conversations of several rows: words that a row shares with the one before, and whether a leaf ends it."""
    rows = np.flatnonzero(shard.more | (shard.level > 0))
    common = shard.words_to(rows, np.maximum(shard.shared[rows], shard.base[rows])) - shard.before[rows]
    values = [shard.convs[rows], shard.level[rows], common, shard.leaf[rows].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["conv", "level", "common", "leaf"])


def _path_rows(shard: Shard) -> pa.RecordBatch:
    """Every prefix inside the rows of conversations that go on."""
    rows = np.flatnonzero(shard.more)
    count = (shard.end - shard.base)[rows]
    row = np.repeat(rows, count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + shard.base[row] + 1
    values = [shard.convs[row], shard.level[row], depth, *shard.ids(shard.candidate(row, depth))]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["conv", "level", "depth", *ID])


# ---------------------------------------------------------------- nodes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of one partition as lists of bounded length under one key."""
    part, seq = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i in range(0, len(ids), 1024):
            text = ",".join(map(str, ids[i : i + 1024]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (-1, 0, part + seq)] + [pa.array([text])], [*ID, "at", "ends"]
            )
            seq += 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each key, which come in order; one state at a time is held."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], [*ID, "ends_sha256"]
        )

    for batch in batches:
        for shard, place, text in zip(*(batch.column(c).to_pylist() for c in (*ID, "ends")), strict=True):
            if key != (shard, place):
                if key is not None:
                    yield row()
                key, state = (shard, place), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if key is not None:
        yield row()


def trie(turns: DataFrame, turnless: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nodes of the trie over ``conv, depth, digest, words`` rows, depths from 1 without gaps, and ``turnless`` ids.

    Columns as of :func:`prefix_trie`. Without conversations there are no nodes.
    """
    spark = turns.sparkSession
    ready(spark)
    context = spark.sparkContext
    chunks, deep = _chunks(turns, chunk)
    order = ["level", "g1", "g2", "key", "more", "conv"]
    rows = chunks.select("level", "g1", "g2", "conv", "before", "more", "key", "words")
    laid = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    cut = shared_table(laid.mapInArrow(_shards(chunk), _SHARD_DDL), "shards")
    counts = sorted(map(tuple, cut.groupBy("part").count().collect()))
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part int, base long")
    numbered = cut.join(F.broadcast(bases), "part").withColumn("number", F.expr("base + seq"))
    edges = numbered.select("number", "first", "inner").join(
        numbered.select((F.col("number") + 1).alias("number"), F.col("last")), "number", "left"
    )
    border = _borders(chunk)(F.coalesce("last", F.unhex(F.lit(""))), F.col("first"))
    found = sorted(map(tuple, edges.select("number", border, "inner").collect()))
    values = np.array(found, np.int64).reshape(-1, 3)
    borders = context.broadcast(Borders(values[:, 1], values[:, 2])) if len(found) else None
    columns = ["number", *_SHARD[6:]]
    if borders is None:
        none = spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
        return _with_root(none, turnless, None)
    parts = shared_table(numbered.select(*columns).mapInArrow(_on_shards(borders, chunk, _part_rows), _PART_DDL), "parts")

    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "common")]
    # Every shard but the first of a stretch repeats its parent as it sees it; all name the same.
    same = [F.max(c).alias(c) for c in ("depth", "before", "parent", "up_shard", "up_place")]
    crossing = group_for_join(parts.where("crosses"), ID).agg(F.min("conv").alias("conv"), *sums, *same).drop(SPREAD)
    crossing = shared_table(crossing, "crossing")
    pieces = parts.where("crosses AND ends IS NOT NULL").select(*ID, "at", "ends")
    sorted_ids = turnless.repartitionByRange(shuffle_width(spark), "conv").sortWithinPartitions("conv")
    pieces = pieces.unionByName(sorted_ids.mapInArrow(_pieces, "shard long, place long, at long, ends string"))
    hashes = shared_table(
        pieces.repartition(*ID).sortWithinPartitions(*ID, "at").mapInArrow(_hashed, "shard long, place long, ends_sha256 string"), "ends"
    )
    kept = [*ID, "depth", "conv", "n", "children", "leaves", "common", "before", "parent", "up_shard", "up_place"]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = parts.where("NOT crosses").select(*kept, F.coalesce(F.sha2("ends", 256), none).alias("ends_sha256"))
    joined = crossing.join(hashes, ID, "left").select(*kept, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    nodes = whole.unionByName(joined).withColumn("saved", F.expr("common - (n - 1) * before"))
    above = crossing.select(F.col("shard").alias("up_shard"), F.col("place").alias("up_place"), F.col("conv").alias("up_conv"))
    known, unknown = nodes.where("up_shard IS NULL"), nodes.where("up_shard IS NOT NULL")
    found = unknown.join(above, ["up_shard", "up_place"]).withColumn("parent", F.col("up_conv")).drop("up_conv")
    nodes = known.unionByName(found)
    if deep:
        nodes = _with_deeper(nodes, numbered.where("deep").select(*columns), borders, chunk)
    named = nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
    return _with_root(shared_table(named, "nodes"), turnless, hashes)


def _with_deeper(nodes: DataFrame, shards: DataFrame, borders: Broadcast, chunk: int) -> DataFrame:
    """Nodes with what conversations that go on in further rows have there: leaves, saved words and children."""
    nodes = shared_table(nodes, "level-nodes")
    rows = shards.mapInArrow(_on_shards(borders, chunk, _deep_rows), "conv long, level long, common long, leaf long")
    later = Window.partitionBy("conv").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    after = rows.select("conv", "level", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"more_{c}") for c in ("common", "leaf")))
    paths = shards.mapInArrow(_on_shards(borders, chunk, _path_rows), "conv long, level long, depth long, shard long, place long")
    paths = shared_table(paths, "paths")
    gains = paths.join(after, ["conv", "level"]).groupBy(*ID).agg(F.sum("more_common").alias("more_common"), F.sum("more_leaf").alias("more_leaf"))
    up = paths.where(F.col("depth") == (F.col("level") + 1) * chunk).select(
        "conv", (F.col("depth") + 1).alias("depth"), F.col("shard").alias("to_shard"), F.col("place").alias("to_place")
    )
    tops = nodes.where(f"depth > 1 AND (depth - 1) % {chunk} = 0").select(*ID, "conv", "depth").join(up, ["conv", "depth"])
    tops = shared_table(tops, "tops")
    born = tops.groupBy(F.col("to_shard").alias("shard"), F.col("to_place").alias("place")).agg(F.count(F.lit(1)).alias("born"))
    names = nodes.select(F.col("shard").alias("to_shard"), F.col("place").alias("to_place"), F.col("conv").alias("to_conv"))
    parents = tops.join(names, ["to_shard", "to_place"]).select(*ID, "to_conv")
    added = reduce(lambda df, more: df.join(more, ID, "left"), (gains, born, parents), nodes)
    zero = F.lit(0).cast("long")
    return added.withColumns(
        {
            "children": F.col("children") + F.coalesce("born", zero),
            "leaves": F.col("leaves") + F.coalesce("more_leaf", zero),
            "saved": F.col("saved") + F.coalesce("more_common", zero),
            "parent": F.coalesce("to_conv", "parent"),
        }
    )


def _with_root(nodes: DataFrame, turnless: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """All nodes and the root, which is the parent of those of depth 1; it has no text and saves nothing of its own."""
    spark = nodes.sparkSession
    empty = turnless.agg(F.min("conv"), F.count(F.lit(1))).first()
    top = nodes.where("depth = 1")
    own = top.agg(F.min("conv_id"), F.sum("n_convs"), F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    smallest = min((c for c in (empty[0], own[0]) if c is not None), default=None)
    if smallest is None:
        return nodes
    if hashes is None:
        ids = turnless.repartitionByRange(shuffle_width(spark), "conv").sortWithinPartitions("conv")
        pieces = ids.mapInArrow(_pieces, "shard long, place long, at long, ends string")
        hashes = pieces.repartition(*ID).sortWithinPartitions(*ID, "at").mapInArrow(_hashed, "shard long, place long, ends_sha256 string")
    ends = hashes.where("shard = -1").first()
    digest = ends["ends_sha256"] if ends else hashlib.sha256(b"").hexdigest()
    root = (smallest, 0, None, empty[1] + (own[1] or 0), own[2], own[3] or 1, own[4] or 0, digest)
    first = spark.createDataFrame([root], nodes.schema)
    rest = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.col("parent_conv_id")))
    return first.unionByName(rest)


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations, and the root.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes below, itself included),
    ``saved_tokens`` (words that members after the first need not repeat, over the
    subtree) and ``ends_sha256`` (of the ids of those that end there). Turns are equal by
    their 128-bit digests of role and text. Nulls, ties and repeated rows are treated as
    :func:`ordered_turns` says; an empty table has no nodes.
    """
    turns = ordered_turns(conversations, conv_id, turn, role, text)
    no_ids = turns.where("false").select("conv")
    return trie(turns.selectExpr("conv", "pos + 1 AS depth", "digest", "words"), no_ids, chunk)


#: The same nodes in SQL over ``conversations``; CRC-32 is worked out bit by bit.
ORACLE = r"""
WITH original AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, c - c % 20 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                                      list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                                  lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM original),
sequence AS (
  SELECT convs.c, 0 AS piece, o.pos, o.digest, o.words FROM convs JOIN original o ON o.c = base AND o.pos < h
  UNION ALL
  SELECT convs.c, 1, o.pos, o.digest, o.words FROM convs JOIN original o ON o.c = convs.c AND o.pos >= h),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY piece, pos) AS d, digest, words FROM sequence),
prefix AS (
  SELECT c, d, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(d) AS n FROM prefix GROUP BY c),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM prefix JOIN lengths USING (c) GROUP BY path, d),
children AS (
  SELECT v.path, count(w.path) AS n_children FROM nodes v LEFT JOIN nodes w ON w.d = v.d + 1 AND left(w.path, len(v.path)) = v.path
  GROUP BY v.path),
below AS (
  SELECT p.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM nodes v JOIN children USING (path) JOIN prefix p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.path)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN children USING (path) JOIN below USING (path)
LEFT JOIN nodes up ON v.d > 0 AND up.path = left(v.path, 32 * (v.d - 1))
"""
