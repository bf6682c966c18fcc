"""Ranked search against plain scoring of all documents, on the tables and on odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tests.llm.test_operators import SF
from tests.oracle import differences
from viewforge.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, counts), size in zip(held, sizes, strict=True):
            score = 0
            for term in TERM.findall((text or "").translate(LOWER)):
                if term in counts:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * counts[term] // (1000 * counts[term] + 8 * (25 + 75 * size * n // total)))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if named else None, -s) for rank, (s, named, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_query_by_sql_and_by_brute_force(spark):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    result = queries.op13_lexical_search(spark, SF)
    assert differences(result, connection, lexical.ORACLE) == []
    docs = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(result, "item_id", "rank", "doc_id", "score") == brute(docs, items)


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty and long texts, ties, repeated rows, other column names, blocks of items, no rows."""
    docs = [(3, "Apple pie"), (1, "apple PIE"), (1, "apple PIE"), (None, "apple pie"), (2, None), (4, ""), (5, "ÉTÉ été apple " * 20_000), (6, "--- !")]
    items = [("a", "Apple apple pie"), ("b", None), ("b", ""), (None, "ÉTÉ"), ("c", "nowhere"), ("a", "pie"), ("a", "pie")]
    texts = spark.createDataFrame([(t, "x", d) for d, t in docs], "`the.text` string, score string, id long")
    asked = spark.createDataFrame([(t, i) for i, t in items], "body string, rank string")
    names = dict(doc_id="id", text="the.text", item_id="rank", item_text="body")
    for size in (1 << 22, 8):
        monkeypatch.setattr(lexical, "QUERY_BYTES", size)
        out = lexical.search(texts, asked.withColumnRenamed("rank", "item"), k=2, **names | {"item_id": "item"})
        assert out.columns == ["item", "rank", "id", "score"]
        assert found(out, "item", "rank", "id", "score") == brute(docs, items, 2)
    out = lexical.search(texts.limit(0), asked, **names | {"item_id": "rank", "doc_id": "id"})
    assert out.count() == 0 and out.columns == ["item_id", "rank", "id", "score"]
    assert lexical.search(texts, asked.limit(0), doc_id="id", text="the.text", item_id="body", item_text="body").count() == 0


def test_pruned_buckets_lose_nothing(monkeypatch):
    """Many small buckets: exact scores of all documents that reach the score to beat, few others looked at."""
    monkeypatch.setattr(lexical, "BUCKET_TERMS", 60)
    draw = random.Random(13)
    vectors = []
    for doc in range(400):
        terms = sorted(draw.sample(range(50), draw.randint(1, 12)))
        vectors.append((doc, terms, [int(10 ** draw.uniform(0, 9)) for _ in terms]))
    vectors.append((400, list(range(100)), [5] * 100))
    lengths = [float(np.sqrt(np.sum(np.array(x, float) ** 2))) for _, _, x in vectors]
    order = sorted(range(len(vectors)), key=lambda i: -lengths[i])
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([vectors[i][0] for i in order], pa.int64()),
            pa.array([lengths[i] for i in order]),
            pa.array([vectors[i][1] for i in order], pa.list_(pa.int32())),
            pa.array([vectors[i][2] for i in order], pa.list_(pa.int64())),
        ],
        ["doc", "length", "terms", "impacts"],
    )
    parts = [batch.slice(0, 7), batch.slice(7, 250), batch.slice(257)]
    buckets = [r for b in lexical._buckets(iter(parts)) for r in zip(*b.columns, strict=True)]
    assert len(buckets) > 30 and [d.as_py() for b in buckets for d in b[1].values] == batch.column(0).to_pylist()
    for _ in range(40):
        terms = np.array(sorted(draw.sample(range(60), 6)))
        counts = np.array([draw.randint(1, 3) for _ in terms])
        query = dict(zip(terms.tolist(), counts.tolist(), strict=True))
        every = [sum(query.get(t, 0) * x for t, x in zip(ts, xs, strict=True)) for _, ts, xs in vectors]
        best, looked = lexical.Best(5, 1), 0
        for longest, docs, *columns in buckets:
            bucket = lexical.Bucket(longest.as_py(), *(c.as_py() for c in columns))
            least = best.least
            rows, scores = bucket.search(terms, counts, least)
            ids = docs.values.take(pa.array(rows))
            assert all(every[i] == s for i, s in zip(ids.to_pylist(), scores.tolist(), strict=True))
            assert {i for i in docs.values.to_pylist() if every[i] >= least} <= set(ids.to_pylist())
            best.add(scores, ids)
            looked += len(rows)
        want = sorted((-s, i) for i, s in enumerate(every) if s > 0)[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want
        assert looked < 200


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 3, 1 << 31]), np.array([10, 1 << 40, 1 << 41])
    for documents, terms in ((1 << 35, 1 << 45), (7, 90)):
        want = [10**9 * t // (1000 * t + 8 * (25 + 75 * int(x) * documents // terms)) for t, x in zip(tf.tolist(), n.tolist(), strict=True)]
        assert lexical.impacts(tf, n, documents, terms).tolist() == want
