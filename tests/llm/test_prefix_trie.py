"""The prefix trie against a plain one, with small rows and shards, hot prefixes and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import SF
from viewforge.llm import prefix_trie as P
from viewforge.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grouped(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = own + sum(saved[p] for p in children[path])
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((ids[0], len(path), parent, len(ids), len(children[path]), leaves[path], saved[path], digest))
    return sorted(out, key=str)


def found(df):
    assert df.columns == P.NODE
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, SF)) == brute(rebuilt(grouped(rows)))


def drawn(seed, n=300, longest=9):
    """Conversations over few turns: many copies, prefixes of each other and shared beginnings; a third begin alike."""
    draw, rows = random.Random(seed), []
    said = [f"turn {i} " + "word " * i for i in range(3)]
    for conv in draw.sample(range(-500, 5000), n):
        turns = [draw.choice(said) for _ in range(draw.randint(1, longest))]
        if conv % 3 == 0:
            turns[:2] = said[:2]
        rows += [(conv, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(turns)]
    draw.shuffle(rows)
    return rows


DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [1 << 12, 4, 3])
def test_rows_of_few_turns(spark, chunk):
    """Conversations cut into rows of three or four turns give the same nodes."""
    rows = drawn(chunk)
    turns = P.ordered_turns(spark.createDataFrame(rows, DDL).repartition(7))
    assert found(P.trie(*P.spliced_turns(turns), chunk)) == brute(rebuilt(grouped(rows)))
    assert found(P.prefix_trie(spark.createDataFrame(rows, DDL), chunk=chunk)) == brute(grouped(rows))


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, ties, no base, conversations without turns, other columns."""
    rows = [
        (None, 0, "user", "of no conversation"),
        (20, None, None, None),
        (20, 1, "user", ""),
        (20, 1, "user", ""),
        (21, 5, "user", "a  b\tc d"),
        (22, 5, "user", "x " * 50_000),
        (23, 0, "", ""),
        (67, 0, "user", "base is absent"),
        (68, 0, "user", "base is absent"),
        (-7, 0, "user", "negative"),
    ]
    rows += [(c, i, "user", "same") for c in range(100, 130) for i in range(3)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], DDL + ", depth int, `n.convs` string")
    assert found(P.trie(*P.spliced_turns(P.ordered_turns(frame)))) == brute(rebuilt(grouped(rows)))
    assert any(not t for t in rebuilt(grouped(rows)).values())
    assert P.trie(*P.spliced_turns(P.ordered_turns(frame.limit(0)))).count() == 0


def test_one_conversation_over_many_partitions(spark):
    """A conversation with most of all rows is numbered by many tasks and cut into many rows."""
    rows = [(1, i, "user", f"t{i % 5}") for i in range(3000)] + [(2, i, "user", f"t{i % 5}") for i in range(2500)] + [(3, 0, "user", "t0")]
    frame = spark.createDataFrame(rows, DDL).repartition(8)
    assert [tuple(r) for r in P.ordered_turns(frame).where("conv = 1").orderBy("pos").select("pos").collect()] == [(i,) for i in range(3000)]
    got = P.prefix_trie(frame, chunk=64).collect()
    nodes = {(r.depth, r.conv_id): r for r in got}
    assert len(got) == 3001 and all(nodes[d, 1].n_convs == 3 - (d > 1) - (d > 2500) for d in range(1, 3001))
    assert all(nodes[d, 1].n_leaves == 1 and nodes[d, 1].parent_conv_id == 1 for d in range(1, 3001))
    assert nodes[1, 1].saved_tokens == 2 + 2499 and nodes[2500, 1].saved_tokens == 1 and nodes[2501, 1].saved_tokens == 0


def test_range_minima():
    draw = np.random.default_rng(11)
    for n in (1, 2, 3, 17, 200):
        values = draw.integers(0, 6, n)
        table = P.Minima(values)
        at, least = np.repeat(np.arange(n), 7), np.tile(np.arange(7), n)
        right, left = table.right(at, least), table.left(at, least)
        for i, d, r, a in zip(at, least, right, left, strict=True):
            assert all(values[i + 1 : r + 1] >= d) and (r == n - 1 or values[r + 1] < d)
            assert all(values[a + 1 : i + 1] >= d) and (a == 0 or values[a] < d)
        b = np.minimum(at + draw.integers(0, n, len(at)), n - 1)
        assert table.between(at, b).tolist() == [values[i : j + 1].min() for i, j in zip(at, b, strict=True)]
