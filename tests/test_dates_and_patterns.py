"""Date ranges and partition patterns."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from viewforge.functions import dates
from viewforge.operators.partitions import expand_partitions, select_partitions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def day(text):
    return datetime.date.fromisoformat(text)


def test_day_and_month_ranges(spark):
    days = value(spark, dates.day_range("2014-10-15", "2014-11-14"))
    assert len(days) == 31 and days[0] == day("2014-11-14") and days[-1] == day("2014-10-15")
    months = value(spark, dates.month_range("2014-01-11", "2014-11-16"))
    assert len(months) == 11 and months[0] == day("2014-11-01") and months[-1] == day("2014-01-01")
    assert value(spark, dates.day_range("2014-10-15", "2014-10-14")) == []


def test_ranges_stop_at_the_earliest_day(spark):
    assert value(spark, dates.day_range("2013-11-01", "2013-12-03"))[-1] == day("2013-12-01")
    assert value(spark, dates.this_and_prev_days("2013-12-03")) == [
        day("2013-12-03"),
        day("2013-12-02"),
        day("2013-12-01"),
    ]
    assert value(spark, dates.this_and_prev_months("2014-02-10")) == [
        day("2014-02-01"),
        day("2014-01-01"),
        day("2013-12-01"),
    ]
    assert value(spark, dates.this_and_prev_days_of_month("2013-12-10"))[0] == day("2013-12-31")


def test_previous_day_and_month(spark):
    assert value(spark, dates.prev_day(F.lit("2014-01-01"))) == day("2013-12-31")
    assert value(spark, dates.prev_day(F.lit("2013-12-01"))) is None
    assert value(spark, dates.prev_month(F.lit("2014-01-31"))) == day("2013-12-01")
    assert value(spark, dates.prev_month(F.lit("2013-12-31"))) is None


def test_days_of_a_month(spark):
    days = value(spark, dates.all_days_of_month(F.lit("2014-02-11")))
    assert [d.day for d in days] == list(range(28, 0, -1))


def test_last_days_and_months_span_their_count(spark):
    assert value(spark, dates.last_days(F.lit("2014-03-03"), -3)) == [
        day("2014-03-03"),
        day("2014-03-02"),
        day("2014-03-01"),
        day("2014-02-28"),
    ]
    assert value(spark, dates.last_months(F.lit("2014-03-31"), -2)) == [
        day("2014-03-01"),
        day("2014-02-01"),
        day("2014-01-01"),
    ]


def expand(spark, *parameters, names=None):
    names = names or [f"c{i}" for i in range(9)]
    for width in range(1, 10):
        try:
            return expand_partitions(spark, parameters, names[:width])
        except ValueError:
            continue
    raise AssertionError(parameters)


def test_single_values(spark):
    assert expand(spark, "EC0106", "2014").collect() == [("EC0106", "2014")]
    row = expand(spark, "i(3)", "l(4)", "b(5)", "f(1.5)", "d(-2e3)", "t(true)", "null()").collect()[0]
    assert tuple(row) == (3, 4, 5, 1.5, -2000.0, True, None)
    assert expand(spark, "ym(201402)").collect() == [("2014", "02")]
    assert expand(spark, "ymd(20140220)").collect() == [("2014", "02", "20")]


def test_ranges_order_themselves(spark):
    for pattern in ("rym(201312-201402)", "rym( 201402 - 201312 )"):
        assert [tuple(r) for r in expand(spark, pattern).collect()] == [("2014", "02"), ("2014", "01"), ("2013", "12")]
    assert expand(spark, "rymd(20140224-20131202)").count() == 85


def test_enumerations(spark):
    assert [r[0] for r in expand(spark, "ei(1,2,3)").collect()] == [1, 2, 3]
    assert [r[0] for r in expand(spark, "e(1,2,3)").collect()] == ["1", "2", "3"]
    assert [r[0] for r in expand(spark, r"e(a\,b,c\-d,\(x\))").collect()] == ["a,b", "c-d", "(x)"]
    months = {"".join(r) for r in expand(spark, "erym(201402-201401,201406-201405)").collect()}
    assert months == {"201401", "201402", "201405", "201406"}


def test_products(spark):
    df = expand(spark, "EC0106", "rymd(20140224-20131202)", "rym(201402-201312)", "ei(9,10)")
    assert df.count() == 85 * 3 * 2 and df.distinct().count() == 85 * 3 * 2


def test_wrong_number_of_names(spark):
    with pytest.raises(ValueError):
        expand_partitions(spark, ["ym(201402)"], ["year"])
    with pytest.raises(ValueError):
        expand_partitions(spark, ["a"], ["x", "y"])


def test_select_partitions_matches_nulls(spark):
    data = spark.createDataFrame([("a", 1), (None, 2)], "p string, n int")
    wanted = expand_partitions(spark, ["null()"], ["p"])
    assert select_partitions(data, wanted).collect() == [(None, 2)]


def test_select_partitions_skips_other_folders(spark, tmp_path):
    """Two columns, four folders each, wanted partitions from a pattern and from a table."""
    path = str(tmp_path / "t")
    spark.range(400).select(
        "id", (F.col("id") % 4).cast("string").alias("y"), (F.col("id") % 5).cast("string").alias("m")
    ).write.partitionBy("y", "m").parquet(path)
    data = spark.read.schema("id long, y string, m string").parquet(path)
    stored = str(tmp_path / "wanted")
    spark.createDataFrame([("1", "2"), ("3", "2")], "y string, m string").write.parquet(stored)
    for wanted in (expand_partitions(spark, ["e(1,3)", "2"], ["y", "m"]), spark.read.parquet(stored)):
        selected = select_partitions(data, wanted)
        assert sorted(r.id for r in selected.collect()) == [i for i in range(400) if i % 4 in (1, 3) and i % 5 == 2]
        plan = selected._jdf.queryExecution().executedPlan().toString()
        assert plan.count("dynamicpruning#") >= 2
        assert selected.columns == data.columns
    both = spark.createDataFrame([("1", "2"), (None, "2")], "y string, m string")
    assert select_partitions(data, both).count() == 20


def test_ten_million_combinations_are_built_by_many_tasks(spark):
    letters = ",".join(f"v{i}" for i in range(100))
    frame = expand_partitions(spark, [f"e({letters})", f"e({letters})", "ei(1,2)", "rymd(20140101-20150516)"], ["a", "b", "n", "y", "m", "d"])
    days = 501
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert frame.rdd.getNumPartitions() > 1 and "from_json" not in plan and "Generate" not in plan
    got = frame.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("a", "b", "n", "y", "m", "d"), 0.01)).first()
    assert got[0] == 100 * 100 * 2 * days and abs(got[1] / got[0] - 1) < 0.05
    one = frame.where("a = 'v7' AND b = 'v9' AND n = 2").select("y", "m", "d")
    assert one.count() == one.distinct().count() == days
    assert one.agg(F.min(F.struct("y", "m", "d")), F.max(F.struct("y", "m", "d"))).first() == (("2014", "01", "01"), ("2015", "05", "16"))


def test_more_combinations_than_numbers_are_refused(spark):
    many = "e(" + ",".join(map(str, range(64))) + ")"
    with pytest.raises(ValueError, match="more than can be numbered"):
        expand_partitions(spark, [many] * 11, list("abcdefghijk"))
