"""From state to recomputed partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewforge.model import Field, ViewDef
from viewforge.operators import state as st
from viewforge.operators.partitions import select_partitions
from viewforge.plans.refresh import partition_text, partition_values, refresh_partitions
from viewforge.sources.formats import read_view, write_view

SALES = ViewDef("Sales", [Field("n", "int")], partitions=[Field("year", "string"), Field("month", "string")])
KEY = "view string, partition string, checksum string, ts long"


def sales(spark, *rows):
    return spark.createDataFrame(list(rows), "n int, year string, month string")


def test_partition_texts(spark):
    df = sales(spark, (1, "2014", "10")).select(partition_text(["year", "month"]).alias("partition"))
    assert df.collect() == [("year=2014/month=10",)]
    assert partition_values(df, SALES).collect() == [("year=2014/month=10", "2014", "10")]


def test_only_stale_partitions_are_rebuilt(spark, tmp_path):
    table, log = str(tmp_path / "sales"), str(tmp_path / "state")
    name = SALES.table_name()
    write_view(sales(spark, (1, "2014", "01"), (2, "2014", "02"), (3, "2014", "03")), SALES, table)
    texts = [f"year=2014/month=0{m}" for m in (1, 2, 3)]
    st.append_state(spark.createDataFrame([(name, t, "q", ts) for t, ts in zip(texts, (9, 2, 2))], KEY), log, 1)
    leaves = spark.createDataFrame([("raw", t, "r", 5) for t in texts], KEY)
    deps = spark.createDataFrame(
        [(name, t, "raw", t) for t in texts], "view string, partition string, dep_view string, dep_partition string"
    )
    current = spark.createDataFrame([(name, "q"), ("raw", "r")], "view string, checksum string")

    def stale(now):
        return st.stale_partitions(st.read_state(spark, log).unionByName(leaves), deps, current, now)

    assert sorted(r.partition for r in stale(50).collect()) == texts[1:]
    source = sales(spark, (10, "2014", "01"), (20, "2014", "02"), (21, "2014", "02"))
    done = refresh_partitions(SALES, lambda wanted: select_partitions(source, wanted), stale(50), table, log, "q", 50)
    assert {r.partition: r.has_data for r in done.collect()} == {texts[1]: True, texts[2]: False}
    # The first month was fresh and stays, the second is replaced, the third has no rows any more.
    assert sorted(map(tuple, read_view(spark, SALES, table).collect())) == [
        (1, "2014", "01"),
        (20, "2014", "02"),
        (21, "2014", "02"),
    ]
    after = {r.partition: r.ts for r in st.read_state(spark, log).collect()}
    assert after == {texts[0]: 9, texts[1]: 50, texts[2]: 2}
    assert [r.partition for r in stale(60).collect()] == [texts[2]]


def test_no_row_for_any_stale_partition(spark, tmp_path):
    write_view(sales(spark, (1, "2014", "01"), (2, "2014", "02")), SALES, str(tmp_path / "t"))
    stale = spark.createDataFrame([(SALES.table_name(), "year=2014/month=02")], "view string, partition string")
    done = refresh_partitions(
        SALES, lambda w: sales(spark, (1, "a", "b")).limit(0), stale, str(tmp_path / "t"), str(tmp_path / "s"), "q", 5
    )
    assert [r.has_data for r in done.collect()] == [False]
    assert sorted(map(tuple, read_view(spark, SALES, str(tmp_path / "t")).collect())) == [(1, "2014", "01")]


def test_nothing_stale(spark, tmp_path):
    write_view(sales(spark, (1, "2014", "01")), SALES, str(tmp_path / "t"))
    none = spark.createDataFrame([], "view string, partition string")
    done = refresh_partitions(
        SALES, lambda w: select_partitions(sales(spark, (2, "2014", "01")), w), none, str(tmp_path / "t"), str(tmp_path / "s"), "q", 5
    )
    assert done.count() == 0
    assert read_view(spark, SALES, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 1


def test_emptied_partitions_keep_their_folder(spark, tmp_path):
    """Many partitions without rows are emptied; the others stay as they are."""
    path = tmp_path / "t"
    write_view(sales(spark, *((m, "2014", f"{m:02}") for m in range(1, 13))), SALES, str(path))
    stale = spark.createDataFrame(
        [(SALES.table_name(), f"year=2014/month={m:02}") for m in range(3, 13)], "view string, partition string"
    )
    source = sales(spark, (50, "2014", "05"))
    done = refresh_partitions(
        SALES, lambda w: select_partitions(source, w), stale, str(path), str(tmp_path / "s"), "q", 5
    )
    assert sorted(r.partition for r in done.where("has_data").collect()) == ["year=2014/month=05"]
    assert done.count() == 10
    assert sorted(r.n for r in read_view(spark, SALES, str(path)).collect()) == [1, 2, 50]
    assert (path / "year=2014" / "month=07").is_dir()
    assert not list((path / "year=2014" / "month=07").glob("*.parquet"))


def test_a_refresh_reads_only_the_wanted_folders_of_its_source(spark, tmp_path):
    source = str(tmp_path / "raw")
    write_view(sales(spark, *((m, "2014", f"{m:02}") for m in range(1, 13))), SALES, source)
    plans = []

    def build(wanted):
        rows = select_partitions(read_view(spark, SALES, source), wanted)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    stale = spark.createDataFrame([(SALES.table_name(), "year=2014/month=03")], "view string, partition string")
    refresh_partitions(SALES, build, stale, str(tmp_path / "t"), str(tmp_path / "s"), "q", 5)
    assert "dynamicpruning#" in plans[0]
    assert [r.n for r in read_view(spark, SALES, str(tmp_path / "t")).collect()] == [3]


def test_no_partition_is_lost_to_its_name(spark, tmp_path):
    """Numbers with leading zeros, null, empty and escaped values: rebuilt ones stay, emptied ones go, others are not touched."""
    view = ViewDef("Odd", [Field("n", "int")], partitions=[Field("month", "int"), Field("tag", "string")])
    tags = ["a/b", "a", "50%", "x y", "k=v:w", "1+1", None]
    rows = [(i, 5, tag) for i, tag in enumerate(tags)] + [(90, 6, "a/b"), (91, None, "gone/x"), (92, None, "kept")]
    source = spark.createDataFrame(rows, "n int, month int, tag string")
    path = str(tmp_path / "t")
    write_view(source, view, path)
    texts = [f"month=05/tag={t}" for t in ("a%2Fb", "a", "50%25", "50%", "x y", "k%3Dv%3Aw", "1+1", "__HIVE_DEFAULT_PARTITION__")]
    texts.append("month=__HIVE_DEFAULT_PARTITION__/tag=gone%2Fx")
    stale = spark.createDataFrame([(view.table_name(), t) for t in texts], "view string, partition string")
    fresh = source.where("tag IS NULL OR tag <> 'gone/x'").withColumn("n", F.col("n") + 100)
    done = refresh_partitions(view, lambda w: select_partitions(fresh, w), stale, path, str(tmp_path / "s"), "q", 5)
    assert {r.partition: r.has_data for r in done.collect()} == {t: "gone" not in t for t in texts}
    expected = [(i + 100, 5, tag) for i, tag in enumerate(tags)] + [(90, 6, "a/b"), (92, None, "kept")]
    assert sorted(map(tuple, read_view(spark, view, path).collect())) == sorted(expected)
