"""Partition state, staleness and flags."""

from __future__ import annotations

import random

import pytest

from viewforge.operators import state as st

NOW = 100
STATE = (
    "view string, partition string, checksum string, ts long, has_data boolean, failed boolean, materialize_once boolean"
)
DEPS = "view string, partition string, dep_view string, dep_partition string"
CURRENT = "view string, checksum string"


def run(spark, state, deps, mode="default", current=None):
    state = [(*s, *(True, False, False)[len(s) - 4 :]) for s in state]
    views = sorted({s[0] for s in state})
    result = st.materialization(
        spark.createDataFrame(state, STATE),
        spark.createDataFrame(deps, DEPS),
        spark.createDataFrame(current or [(v, "q") for v in views], CURRENT),
        NOW,
        mode,
    )
    return {(r.view, r.partition): r for r in result.collect()}


UP = [("up", "p", "leaf1", "p"), ("up", "p", "leaf2", "p")]


def both(ts1=5, ts2=6, up=7, checksum="q"):
    return [("leaf1", "p", "q", ts1), ("leaf2", "p", "q", ts2), ("up", "p", checksum, up)]


def test_fresh_partitions_stay(spark):
    rows = run(spark, both(), UP)
    assert not any(r.recompute for r in rows.values())
    assert rows["up", "p"].new_ts == 7


def test_newer_dependency_makes_stale(spark):
    rows = run(spark, both(ts2=8), UP)
    assert rows["up", "p"].recompute and rows["up", "p"].new_ts == NOW
    assert not rows["leaf2", "p"].recompute


def test_equal_time_is_fresh(spark):
    assert not run(spark, both(ts2=7), UP)["up", "p"].recompute


def test_changed_checksum_makes_stale(spark):
    rows = run(spark, both(checksum="old"), UP)
    assert rows["up", "p"].recompute and rows["up", "p"].new_checksum == "q"


def test_leaf_is_stale_when_it_never_ran_and_so_is_what_depends_on_it(spark):
    rows = run(spark, both(ts1=0), UP)
    assert rows["leaf1", "p"].recompute and rows["up", "p"].recompute


def test_reset_checksums_only_looks_at_data(spark):
    rows = run(spark, both(checksum="old"), UP, "reset_checksums")
    assert not rows["up", "p"].recompute and rows["up", "p"].new_checksum == "q" and rows["up", "p"].new_ts == 7
    assert run(spark, both(ts2=8), UP, "reset_checksums")["up", "p"].recompute


def test_dry_run_writes_state_but_recomputes_nothing(spark):
    rows = run(spark, both(ts1=0, checksum="old"), UP, "reset_checksums_and_timestamps")
    assert not any(r.recompute for r in rows.values())
    assert (rows["up", "p"].new_checksum, rows["up", "p"].new_ts) == ("q", NOW)
    assert rows["leaf1", "p"].new_ts == NOW and rows["leaf2", "p"].new_ts == 6


def test_transform_only_ignores_dependencies(spark):
    rows = run(spark, both(ts2=8), UP, "transform_only")
    assert not rows["up", "p"].recompute
    assert run(spark, both(up=0), UP, "transform_only")["up", "p"].recompute


def test_set_only_marks_everything(spark):
    rows = run(spark, both(checksum="old", ts1=0), UP, "set_only")
    assert all((r.status, r.recompute, r.new_ts, r.new_checksum) == ("materialized", False, NOW, "q") for r in rows.values())


def test_materialize_once(spark):
    done = [("leaf", "p", "q", 0), ("once", "p", "old", 3, True, False, True), ("up", "p", "q", 4)]
    deps = [("once", "p", "leaf", "p"), ("up", "p", "once", "p")]
    rows = run(spark, done, deps)
    assert rows["leaf", "p"].recompute and not rows["once", "p"].recompute and not rows["up", "p"].recompute
    assert rows["once", "p"].new_checksum == "old"
    first = [("leaf", "p", "q", 5), ("once", "p", "q", 0, True, False, True), ("up", "p", "q", 4)]
    rows = run(spark, first, deps)
    assert rows["once", "p"].recompute and rows["up", "p"].recompute


def test_no_data_and_incomplete(spark):
    state = [
        ("leaf1", "p", "q", 0, False, False, False),
        ("leaf2", "p", "q", 3, True, False, False),
        ("only1", "p", "q", 1, True, False, False),
        ("up", "p", "q", 9, True, False, False),
        ("top", "p", "q", 9, True, False, False),
    ]
    deps = [*UP, ("only1", "p", "leaf1", "p"), ("top", "p", "up", "p"), ("top", "p", "only1", "p")]
    rows = run(spark, state, deps)
    assert rows["leaf1", "p"].status == "no_data" and rows["only1", "p"].status == "no_data"
    assert rows["up", "p"].status == "materialized" and rows["up", "p"].incomplete and not rows["up", "p"].with_errors
    assert rows["top", "p"].incomplete and not rows["top", "p"].with_errors


def test_failures_travel_as_errors(spark):
    state = [
        ("leaf1", "p", "q", 0, True, True, False),
        ("leaf2", "p", "q", 3, True, False, False),
        ("up", "p", "q", 9, True, False, False),
        ("top", "p", "q", 9, True, False, False),
    ]
    rows = run(spark, state, [*UP, ("top", "p", "up", "p")])
    assert rows["leaf1", "p"].status == "failed"
    assert all(rows[v, "p"].with_errors and rows[v, "p"].incomplete for v in ("up", "top"))


def test_only_failed_dependencies_give_no_data(spark):
    state = [("leaf", "p", "q", 0, True, True, False), ("up", "p", "q", 0, True, False, False)]
    assert run(spark, state, [("up", "p", "leaf", "p")])["up", "p"].status == "no_data"


def test_cycles_are_reported(spark):
    state = [("a", "p", "q", 1), ("b", "p", "q", 1), ("c", "p", "q", 1)]
    rows = run(spark, state, [("a", "p", "b", "p"), ("b", "p", "a", "p")])
    assert {k[0]: r.status for k, r in rows.items()} == {"a": "cyclic", "b": "cyclic", "c": "materialized"}
    assert not rows["a", "p"].recompute


def brute_force(state, deps, mode):
    """The same decision, one partition at a time."""
    below = {}
    for view, partition, dep_view, dep_partition in deps:
        below.setdefault((view, partition), set()).add((dep_view, dep_partition))
    rows = {(s[0], s[1]): s for s in state}
    done = {}

    def settle(key):
        if key in done:
            return done[key]
        _, _, checksum, ts, has_data, fails, once = rows[key]
        keep = once and ts > 0
        reports = [] if keep else [settle(k) for k in below.get(key, ())]
        leaf = keep or not below.get(key)
        fresh = 1 if leaf else max([r["ts"] for r in reports if r["status"] == "materialized"], default=0)
        data = leaf or any(r["status"] == "materialized" for r in reports)
        incomplete = any(r["status"] != "materialized" or r["incomplete"] for r in reports)
        errors = any(r["status"] == "failed" or r["errors"] for r in reports)
        due = not keep and data and (ts < fresh or (mode != "reset_checksums" and checksum != "q"))
        dry = mode == "reset_checksums_and_timestamps"
        if not keep and not data:
            status = "no_data"
        elif due and not dry and fails:
            status = "failed"
        elif due and not dry and not has_data:
            status = "no_data"
        else:
            status = "materialized"
        ok = status == "materialized"
        done[key] = {
            "status": status,
            "recompute": due and not dry,
            "ts": NOW if ok and due else ts,
            "incomplete": ok and incomplete,
            "errors": ok and errors,
        }
        return done[key]

    return {k: settle(k) for k in rows}


@pytest.mark.parametrize("mode", ["default", "reset_checksums", "reset_checksums_and_timestamps"])
def test_random_graphs_against_brute_force(spark, mode):
    rng = random.Random(7)
    state, deps = [], []
    for graph in range(30):
        n = rng.randint(2, 9)
        for i in range(n):
            view = f"g{graph}v{i}"
            state.append(
                (view, "p", rng.choice(["q", "q", "old"]), rng.choice([0, 1, 5, 9]), rng.random() < 0.8,
                 rng.random() < 0.2, rng.random() < 0.2)
            )
            deps += [(view, "p", f"g{graph}v{j}", "p") for j in range(i) if rng.random() < 0.4]
    deps += deps[:10]
    got = run(spark, state, deps, mode, [(s[0], "q") for s in state])
    expected = brute_force(state, deps, mode)
    for key, want in expected.items():
        r = got[key]
        assert (r.status, r.recompute, r.new_ts, r.incomplete, r.with_errors) == (
            want["status"], want["recompute"], want["ts"], want["incomplete"], want["errors"],
        ), key


def test_rounds_of_a_long_chain_write_only_what_they_reach(spark, tmp_path, monkeypatch):
    """Many levels; thousands of partitions wait for the last one, some of them told by the first one already."""
    monkeypatch.setattr(st, "scratch_path", lambda _, label: str(tmp_path / label))
    chain = [f"{i:03d}" for i in range(40)]
    late = [f"w{i:04d}" for i in range(3000)]
    state = [("v", n, "q", 0 if n == "000" else 5, True, False, False) for n in chain + late]
    deps = [("v", b, "v", a) for a, b in zip(chain, chain[1:])]
    deps += [("v", n, "v", chain[-1]) for n in late] + [("v", n, "v", chain[0]) for n in late[:1000]]
    rows = run(spark, state, deps)
    assert len(rows) == 3040 and all(r.recompute and r.new_ts == NOW for r in rows.values())

    def written(n):
        return sum(f.stat().st_size for f in (tmp_path / "levels" / f"round-{n}").glob("*.parquet"))

    sizes = [written(n) for n in range(40)]
    assert sizes[0] > 2 * max(sizes[1:39]) and sizes[39] > sizes[0] and max(sizes[1:39]) < 4000


def test_partitions_that_wait_long_are_merged_and_found_again(spark, monkeypatch):
    """Every partition of a chain also reports to one that waits for all of them."""
    merged = []
    add = st._add_run
    monkeypatch.setattr(st, "_add_run", lambda spark, schema, waiting, *rest: (add(spark, schema, waiting, *rest), merged.append(len(waiting))))
    names = [f"{i:02d}" for i in range(12)]
    state = [("v", n, "q", 5, True, n == "04", False) for n in names]
    state[4] = ("v", "04", "old", 5, True, True, False)
    state += [("all", "x", "q", 5), ("all", "y", "q", 5), ("never", "z", "q", 5)]
    deps = [("v", b, "v", a) for a, b in zip(names, names[1:])] + [("all", x, "v", n) for n in names for x in "xy"]
    deps += [("never", "z", "v", "00"), ("never", "z", "unknown", "p")]
    rows = run(spark, [(*s, *(True, False, False)[len(s) - 4 :]) for s in state], deps)
    assert rows["v", "04"].status == "failed" and rows["v", "05"].status == "no_data"
    assert all(rows["all", x].with_errors and rows["all", x].incomplete and not rows["all", x].recompute for x in "xy")
    assert rows["never", "z"].status == "cyclic" and len(merged) > 5 and max(merged) <= 3


def test_dependencies_without_state_are_added(spark):
    state = spark.createDataFrame([("up", "p", "q", 4)], "view string, partition string, checksum string, ts long")
    deps = spark.createDataFrame([("up", "p", "leaf", "x")], DEPS)
    rows = {r.view: r for r in st.with_dependencies(state, deps).collect()}
    assert rows["leaf"].ts == 0 and rows["leaf"].checksum == "0" and rows["up"].ts == 4


def test_state_log_keeps_the_newest_row(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "view string, partition string, checksum string, ts long"
    st.append_state(spark.createDataFrame([("v", "a", "c1", 1), ("v", "b", "c1", 1)], schema), path, 1)
    st.append_state(spark.createDataFrame([("v", "a", "c2", 2)], schema), path, 2)
    rows = {r.partition: (r.checksum, r.ts) for r in st.read_state(spark, path).collect()}
    assert rows == {"a": ("c2", 2), "b": ("c1", 1)}


def test_invalidated_partitions_count_as_never_computed(spark):
    schema = "view string, partition string, checksum string, ts long"
    state = spark.createDataFrame([("once", "p", "q", 3), ("other", "p", "q", 3)], schema)
    reset = st.invalidate(state, state.where("view = 'once'"))
    rows = {r.view: (r.checksum, r.ts) for r in reset.collect()}
    assert rows == {"once": ("0", 0), "other": ("q", 3)}
