"""The pipeline's stages against plain Python on the smallest tables, and the queries that have SQL."""

import hashlib
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from tests.llm.test_operators import LONG, SF, contaminated, encoded
from viewforge.llm import queries


def test_stages(spark):
    docs = queries.documents(spark, SF)
    names, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.shared_table(stage(spark, frames[-1], SF), f"test-{name}")
        assert out.columns == names
        frames.append(out)
    start, good, cut, single, clean = ([tuple(r) for r in f.select("doc_id", "text", "source").collect()] for f in frames)

    said = {r.doc_id: r.predicted for r in queries.op1_quality_classifier(spark, SF).collect()}
    assert sorted(r[0] for r in good) == sorted(r[0] for r in start if said[r[0]] == 1)

    pages, seen = Counter(s for _, _, s in good), Counter((s, x) for _, t, s in good for x in set(t.split("\n")))
    gone = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]] and k[1].strip(" \t\r\x0b\x0c")}
    want = {(d, "\n".join(x for x in t.split("\n") if (s, x) not in gone)) for d, t, s in good}
    assert {r[:2] for r in cut} == want

    kept, texts = {r[0] for r in single}, defaultdict(set)
    for d, t, _ in cut:
        texts[t].add(d)
    assert kept <= {r[0] for r in cut} and all(len(ids & kept) <= 1 for ids in texts.values())
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t, _ in cut}
    for d in {r[0] for r in cut} - kept:
        assert max(len(sets[d] & sets[k]) / len(sets[d] | sets[k]) for k in sets if k != d) >= 0.75
    assert not any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85 for a in kept for b in kept if a < b)

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, _, hits, _ in contaminated([r[:2] for r in single], items) if hits}
    assert sorted(r[0] for r in clean) == sorted(kept - dirty)

    pieces = corpus_pipeline.pack(spark, frames[-1], SF).collect()
    lengths = {d: len(i) for (d, _, _), i in zip(clean, encoded([r[:2] for r in clean], 2), strict=True)}
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == Counter(lengths)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, a very long text, and columns named like ours, with dots and back ticks."""
    schema = "doc_id long, text string, source string, `_key` string, `key` string, `a.b` int, `c``d` int, n_dropped string, row string, kept boolean"
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    extra = ("k", "kk", 1, 2, "user", "r", None)
    texts = [("one text of its own", "a"), (None, "a"), ("", None), (None, None), (LONG, "b"), (passage + " and more", "b"), ("twice", "a")]
    rows = [(None if i == 3 else i, t, s, *extra) for i, (t, s) in enumerate(texts)]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and all(r[3:] == extra for r in got), name
        if name in ("lines", "benchmark"):
            want = rows if name == "lines" else [r for r in rows if r[0] != 5]
            assert sorted(got, key=str) == sorted(want, key=str), name
        if name == "near_copies":
            assert [r[1] for r in got].count("twice") == 1 and LONG in [r[1] for r in got]
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.collect() == [], name
    total = Counter()
    for p in corpus_pipeline.pack(spark, docs, SF).collect():
        total[p.doc_id] += p.length
    assert set(total) == {r[0] for r in rows} and total[1] == 1 and corpus_pipeline.pack(spark, docs.limit(0), SF).collect() == []


def test_line_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(connection.execute(queries.ORACLE["op5_line_dedup"]).fetchall())
    got = queries.op5_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want
    assert any(r[2] for r in want) and want[0][3] != hashlib.sha256(b"").hexdigest()
