"""Partition state and the choice of stale partitions.

State tables hold one row per partition: ``view, partition, checksum, ts`` and,
where known, ``has_data, failed, materialize_once``. Dependencies are rows
``view, partition, dep_view, dep_partition``; :func:`with_dependencies` adds
partitions that occur only there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from viewforge.functions.digests import digest
from viewforge.functions.sqltext import with_normalized_sql
from viewforge.operators import state_log
from viewforge.operators.joins import SPREAD, group_for_join
from viewforge.session import remove_folder, scratch_path

KEY = ["view", "partition"]
NEVER = 0
NO_CHECKSUM = "0"

MODES = ("default", "reset_checksums", "reset_checksums_and_timestamps", "transform_only", "set_only")


def partition_metadata(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Checksum and time of every wanted partition; defaults for unknown ones."""
    known = state.select(*KEY, "checksum", "ts")
    return (
        wanted.join(known, KEY, "left")
        .withColumns(
            {
                "checksum": F.coalesce("checksum", F.lit(NO_CHECKSUM)),
                "ts": F.coalesce("ts", F.lit(NEVER).cast("long")),
            }
        )
    )


def with_dependencies(state: DataFrame, deps: DataFrame) -> DataFrame:
    """State with a never-computed row for every partition known only as a dependency."""
    named = deps.select(F.col("dep_view").alias("view"), F.col("dep_partition").alias("partition"))
    new = named.distinct().join(state, KEY, "left_anti")
    return state.unionByName(
        new.select(*KEY, F.lit(NO_CHECKSUM).alias("checksum"), F.lit(NEVER).cast("long").alias("ts")),
        allowMissingColumns=True,
    )


def _flag(df: DataFrame, name: str, default: bool) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _described(state: DataFrame, current: DataFrame) -> DataFrame:
    """State joined to the checksum its view has now; a view without one counts as unchanged."""
    now = group_for_join(current, ["view"]).agg(F.max("checksum").alias("current_checksum")).drop(SPREAD)
    return state.join(now, "view", "left").select(
        *KEY,
        "checksum",
        F.col("ts").cast("long").alias("ts"),
        F.coalesce("current_checksum", "checksum").alias("current_checksum"),
        _flag(state, "has_data", True).alias("has_data"),
        _flag(state, "failed", False).alias("failed"),
        _flag(state, "materialize_once", False).alias("once"),
    )


def materialization(
    state: DataFrame,
    deps: DataFrame,
    current: DataFrame,
    now: int,
    mode: str = "default",
) -> DataFrame:
    """What a run over all partitions would do, one row per partition.

    Result columns: ``view, partition, status, recompute, new_checksum, new_ts,
    with_errors, incomplete``. ``status`` is ``materialized, no_data, failed`` or
    ``cyclic``. A partition is recomputed when its time is older than its newest
    dependency or its view's checksum changed; a recomputed partition counts as
    ``now`` for the partitions that depend on it.

    Partitions are settled one dependency level per round. They are numbered and
    their edges laid out once by the number depended on, each with what a decision
    about its partition needs. A round reads the edges of the partitions settled
    last, skipping pages outside their range of numbers, adds up the reports
    of the partitions these edges lead to, and writes only those; waiting partitions
    that are not touched are neither read nor written.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = _described(state, current)
    if mode == "set_only":
        return rows.select(
            *KEY,
            F.lit("materialized").alias("status"),
            F.lit(False).alias("recompute"),
            F.col("current_checksum").alias("new_checksum"),
            F.lit(now).cast("long").alias("new_ts"),
            F.lit(False).alias("with_errors"),
            F.lit(False).alias("incomplete"),
        )
    if mode == "transform_only":
        leaves = rows.selectExpr("*", "checksum <> current_checksum AS changed", "0L AS n_deps", *LEAF_START)
        return _outcome(_decided(leaves, mode), now, mode)

    base = scratch_path(state.sparkSession, "levels")
    nodes, edges, waiting = _numbered(rows, deps, base)
    settled = _settled(nodes, edges, waiting, now, mode, base)
    verdicts = _decided(settled, mode).select("id", "due", "status", "recompute", "dep_errors", "dep_incomplete")
    return _outcome(nodes.join(verdicts, "id", "left").withColumn("status", F.coalesce("status", F.lit("cyclic"))), now, mode)


#: What the decision about a partition needs beside the reports of its dependencies.
DESCRIPTION = ["ts", "changed", "has_data", "failed", "once", "n_deps"]
#: What a partition starts with: leaves count as fresh since time 1.
LEAF_START = [
    "0L AS n_done",
    "1L AS freshness",
    "true AS any_data",
    "false AS dep_incomplete",
    "false AS dep_errors",
]
REPORTS = ["freshness", "any_data", "dep_incomplete", "dep_errors"]


def _kept(df: DataFrame, path: str, *counts: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table, and figures taken while it is written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _numbered(rows: DataFrame, deps: DataFrame, base: str) -> tuple[DataFrame, DataFrame, int]:
    """All partitions with a number, ``dep, id`` edges with the description of the partition ``id``, and the number that wait.

    A partition that is done once and for all has no edges. A dependency without a row
    of its own counts but never reports, so what needs it cannot settle.
    """
    pairs = deps.select(*KEY, "dep_view", "dep_partition").distinct()
    n_deps = group_for_join(pairs, KEY).agg(F.count(F.lit(1)).alias("n_deps")).drop(SPREAD)
    needed = F.when(F.col("once") & (F.col("ts") > 0), 0).otherwise(F.coalesce("n_deps", F.lit(0))).cast("long")
    changed = F.col("checksum") != F.col("current_checksum")
    described = rows.join(n_deps, KEY, "left").withColumns({"n_deps": needed, "changed": changed, "id": F.monotonically_increasing_id()})
    nodes, count = _kept(described, f"{base}/nodes", F.count_if(F.col("n_deps") > 0).alias("waiting"))
    named = nodes.select(F.col("id").alias("dep"), F.col("view").alias("dep_view"), F.col("partition").alias("dep_partition"))
    wide = pairs.join(nodes.where("n_deps > 0").select("id", *KEY, *DESCRIPTION), KEY).join(named, ["dep_view", "dep_partition"])
    laid = wide.select("dep", "id", *DESCRIPTION).hint("rebalance", F.col("dep")).sortWithinPartitions("dep")
    return nodes, _kept(laid, f"{base}/edges")[0], count["waiting"]


def _settled(nodes: DataFrame, edges: DataFrame, count: int, now: int, mode: str, base: str) -> DataFrame:
    """Every partition whose dependencies have all reported, with the reports added up.

    A round writes the touched partitions with all they were told so far. Those that
    wait for more are looked up when they are touched again; the tables with them are
    merged by size, like a log-structured tree, so there are only a few at any time.
    """
    spark = nodes.sparkSession
    columns = ["id", *DESCRIPTION, "n_done", *REPORTS]
    last = leaves = nodes.where("n_deps = 0").selectExpr("id", *DESCRIPTION, *LEAF_START).select(*columns)
    schema, ready = leaves.schema, F.col("n_done") == F.col("n_deps")
    settled_id = F.when(ready, F.col("id"))
    figures = F.count(settled_id).alias("settled"), F.min(settled_id).alias("low"), F.max(settled_id).alias("high")
    paths, waiting, reached, done = [], [], edges, 0
    while True:
        told = _decided(last, mode).selectExpr(
            "id AS dep",
            "status = 'materialized' AS any_data",
            f"CASE WHEN status <> 'materialized' THEN 0 WHEN due THEN {int(now)}L ELSE ts END AS freshness",
            "status <> 'materialized' OR dep_incomplete AS dep_incomplete",
            "status = 'failed' OR (status = 'materialized' AND dep_errors) AS dep_errors",
        )
        # Map-side sums: a partition with very many dependencies gets one row per task.
        told_of = [F.max(c).alias(c) for c in REPORTS]
        same = [F.max(c).alias(c) for c in DESCRIPTION]
        news = reached.join(told, "dep").groupBy("id").agg(*same, F.count(F.lit(1)).alias("n_done"), *told_of)
        if waiting:
            before = spark.read.schema(schema).parquet(*(p for p, _ in waiting)).where(~ready)
            before = _newest(before.join(news.select("id"), "id", "left_semi"))
            news = news.unionByName(before).groupBy("id").agg(*same, F.sum("n_done").alias("n_done"), *told_of)
        path = f"{base}/round-{len(paths)}"
        touched, found = _kept(news.select(*columns), path, *figures)
        paths.append(path)
        done += found["settled"]
        if not found["settled"] or done == count:
            return leaves.unionByName(spark.read.schema(schema).parquet(*paths).where(ready))
        if found["rows"] > found["settled"]:
            _add_run(spark, schema, waiting, (path, found["rows"] - found["settled"]), base)
        last = touched.where(ready)
        reached = edges.where(F.col("dep").between(found["low"], found["high"]))


def _newest(rows: DataFrame) -> DataFrame:
    """One row per partition: what is told only ever grows, so the newest row is the greatest in each column."""
    return rows.groupBy("id").agg(*(F.max(c).alias(c) for c in (*DESCRIPTION, "n_done", *REPORTS)))


def _add_run(spark: SparkSession, schema, waiting: list[tuple[str, int]], run: tuple[str, int], base: str) -> None:
    """Put a table of waiting partitions beside the others and merge those that it has outgrown."""
    waiting.append(run)
    while len(waiting) > 1 and waiting[-2][1] <= 2 * waiting[-1][1]:
        merged = [waiting.pop(), waiting.pop()]
        rows = spark.read.schema(schema).parquet(*(p for p, _ in merged)).where("n_done < n_deps")
        path = scratch_path(spark, "waiting")
        _, count = _kept(_newest(rows).select(*schema.names), path)
        for old, _ in merged:
            if not old.startswith(base):
                remove_folder(spark, old)
        waiting.append((path, count["rows"]))


def _decided(nodes: DataFrame, mode: str) -> DataFrame:
    """``due``, ``status`` and ``recompute`` of partitions whose dependencies have all reported."""
    changed = "false" if mode == "reset_checksums" else "changed"
    real = str(mode != "reset_checksums_and_timestamps").lower()
    decided = nodes.selectExpr(
        *nodes.columns,
        "once AND ts > 0 AS done_once",
        f"NOT (once AND ts > 0) AND any_data AND (ts < freshness OR {changed}) AS due",
    )
    return decided.selectExpr(
        *decided.columns,
        f"due AND {real} AS recompute",
        f"""CASE WHEN NOT done_once AND NOT any_data THEN 'no_data'
                 WHEN due AND failed AND {real} THEN 'failed'
                 WHEN due AND NOT has_data AND {real} THEN 'no_data'
                 ELSE 'materialized' END AS status""",
    )


def _outcome(decided: DataFrame, now: int, mode: str) -> DataFrame:
    """What becomes of partitions with their decisions; those without one keep what they have."""
    always = "true" if mode == "reset_checksums" else "false"
    return decided.selectExpr(
        *KEY,
        "status",
        "coalesce(recompute, false) AS recompute",
        f"CASE WHEN status = 'materialized' AND (due OR {always}) THEN current_checksum ELSE checksum END AS new_checksum",
        f"CASE WHEN status = 'materialized' AND due THEN {int(now)}L ELSE ts END AS new_ts",
        "status = 'materialized' AND dep_errors AS with_errors",
        "status = 'materialized' AND dep_incomplete AS incomplete",
    )


def stale_partitions(
    state: DataFrame, deps: DataFrame, current: DataFrame, now: int, mode: str = "default"
) -> DataFrame:
    """``view, partition`` of everything a run in this mode would recompute."""
    return materialization(state, deps, current, now, mode).where("recompute").select(*KEY)


def propagate_flags(state: DataFrame, deps: DataFrame, current: DataFrame, now: int) -> DataFrame:
    """Missing data, incompleteness and errors as they travel up the dependencies."""
    result = materialization(state, deps, current, now)
    return result.select(
        *KEY, "status", (F.col("status") == "no_data").alias("no_data"), "incomplete", "with_errors"
    )


def invalidate(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """State with the wanted partitions reset to never computed."""
    marked = wanted.select(*KEY).distinct().withColumn("_reset", F.lit(True))
    reset = F.coalesce("_reset", F.lit(False))
    return state.join(marked, KEY, "left").select(
        *KEY,
        F.when(reset, F.lit(NO_CHECKSUM)).otherwise(F.col("checksum")).alias("checksum"),
        F.when(reset, F.lit(NEVER).cast("long")).otherwise(F.col("ts")).alias("ts"),
    )


def commit_state(state: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """State after a run: updated rows take their new checksum and the time ``now``."""
    old = state.select(*KEY, "checksum", "ts", F.lit(0).alias("_order"))
    new = updates.select(*KEY, "checksum", F.lit(now).cast("long").alias("ts"), F.lit(1).alias("_order"))
    latest = F.max_by(F.struct("checksum", "ts"), F.struct("_order", "ts", "checksum"))
    return (
        old.unionByName(new)
        .groupBy(*KEY)
        .agg(latest.alias("latest"))
        .select(*KEY, "latest.checksum", "latest.ts")
    )


def append_state(updates: DataFrame, path: str, seq: int) -> None:
    """Add rows to the state table under ``path``; either all of them count or none."""
    state_log.commit(updates, path, seq)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per partition of the state table."""
    return state_log.read(spark, path)


# ---------------------------------------------------------------- changed declarations


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``table_name, change`` for frames of ``table_name, checksum``.

    A table that is missing, has no checksum or another checksum is to be
    recreated; one that is declared no more is reported as dropped.
    """
    before = old.select("table_name", F.col("checksum").alias("old_checksum"), F.lit(True).alias("was_there"))
    after = new.select("table_name", F.col("checksum").alias("new_checksum"), F.lit(True).alias("is_there"))
    joined = before.join(after, "table_name", "full")
    change = (
        F.when(F.col("is_there").isNull(), "dropped")
        .when(F.col("was_there").isNull(), "recreate")
        .when(F.col("old_checksum").isNull(), "recreate")
        .when(F.col("old_checksum") != F.col("new_checksum"), "recreate")
        .otherwise("keep")
    )
    return joined.select("table_name", change.alias("change"))


def transformation_checksums(transformations: DataFrame) -> DataFrame:
    """``view, checksum`` from rows of ``view, sql`` and, where given, ``resources, version``.

    An explicit version stands for the query; otherwise the normalised text and
    the digests of its resources count together.
    """
    given = transformations.columns
    normalized = with_normalized_sql(transformations, "sql")
    texts = F.array("sql")
    if "resources" in given:
        texts = F.concat(texts, F.coalesce(F.col("resources"), F.array().cast("array<string>")))
    if "version" in given:
        texts = F.when(F.col("version").isNotNull(), F.array("version")).otherwise(texts)
    return normalized.select("view", texts.alias("texts")).select("view", digest(F.col("texts")).alias("checksum"))


def transformation_changes(state: DataFrame, transformations: DataFrame) -> DataFrame:
    """Partitions whose stored checksum is not the one their view has now."""
    now = transformation_checksums(transformations).select("view", F.col("checksum").alias("new_checksum"))
    return (
        state.join(now, "view")
        .where(~F.col("checksum").eqNullSafe(F.col("new_checksum")))
        .select("view", "partition", "checksum", "new_checksum")
    )
