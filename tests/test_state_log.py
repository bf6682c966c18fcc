"""The versioned state table: merges, versions, writers that meet, and what is left of lost work."""

from __future__ import annotations

import random

import pytest

from viewforge.operators import state_log as log

ROW = "view string, partition string, checksum string, ts long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def state(spark, path, version=None):
    return {(r.view, r.partition): (r.checksum, r.ts) for r in log.read(spark, path, version).collect()}


def test_runs_stay_few_over_a_thousand_commits():
    draw, sizes, rewritten = random.Random(2), [], 0
    for n in range(1000):
        sizes.append(draw.choice([1, 1, 1, 5, 40]))
        first = log.due_for_merge(sizes)
        if first < len(sizes) - 1:
            rewritten += sum(sizes[first:])
            sizes = [*sizes[:first], sum(sizes[first:])]
        assert all(size > 2 * sum(sizes[i + 1 :]) for i, size in enumerate(sizes[:-1]))
        assert len(sizes) <= sum(sizes).bit_length()
    assert rewritten < 10 * sum(sizes)


def test_commits_merges_and_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert log.manifest(spark, path) == (0, []) and state(spark, path) == {}
    want, seen = {}, {}
    for n in range(1, 9):
        values = [("v", f"p{i}", f"c{n}", n) for i in range(n, n + 3)]
        version = log.commit(rows(spark, *values), path, n)
        want |= {(v, p): (c, t) for v, p, c, t in values}
        seen[version] = dict(want)
    assert state(spark, path) == want
    assert len(log.manifest(spark, path)[1]) <= 4
    assert all(state(spark, path, version) == was for version, was in seen.items())
    assert log.commit(rows(spark, *values).limit(0), path, 9) == log.manifest(spark, path)[0]
    log.merge(spark, path, everything=True)
    assert len(log.manifest(spark, path)[1]) <= 1 and state(spark, path) == want
    log.vacuum(spark, path, keep=1, older_than=0)
    assert state(spark, path) == want and len(list((tmp_path / "state" / "data").iterdir())) == 1
    with pytest.raises(Exception):
        log.manifest(spark, path, 1)


def test_an_older_commit_that_comes_late_does_not_count(spark, tmp_path):
    path = str(tmp_path / "state")
    log.commit(rows(spark, ("v", "a", "new", 5), ("v", "a", "same commit, earlier", 4)), path, 7)
    log.commit(rows(spark, ("v", "a", "old", 9), ("v", "b", "old", 9)), path, 6)
    assert state(spark, path) == {("v", "a"): ("new", 5), ("v", "b"): ("old", 9)}


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    """Another commit names the version just before ours; ours comes after it."""
    path, name, others = str(tmp_path / "state"), log._name_version, []

    def overtaken(spark, at, version, runs):
        if not others:
            others.append(True)
            log.commit(rows(spark, ("v", "b", "other", 1)), path, 2)
        return name(spark, at, version, runs)

    monkeypatch.setattr(log, "_name_version", overtaken)
    log.commit(rows(spark, ("v", "a", "ours", 1)), path, 1)
    assert state(spark, path) == {("v", "a"): ("ours", 1), ("v", "b"): ("other", 1)}


@pytest.mark.parametrize("lost", ["before it is named", "to a faster one"])
def test_a_lost_merge_changes_nothing(spark, tmp_path, monkeypatch, lost):
    path, written = str(tmp_path / "state"), log._written
    for n in (1, 2, 3):
        version = log.manifest(spark, path)[0]
        run = log._written(log._newest(rows(spark, ("v", f"p{n}", "c", n)).selectExpr("*", f"{n}L AS seq")), path)
        log._name_version(spark, path, version + 1, [*log.manifest(spark, path)[1], run])
    before = state(spark, path)

    def interrupted(df, at):
        run = written(df, at)
        if lost == "before it is named":
            raise RuntimeError("the driver is gone")
        monkeypatch.setattr(log, "_written", written)
        assert log.merge(spark, path, everything=True)
        return run

    monkeypatch.setattr(log, "_written", interrupted)
    if lost == "before it is named":
        with pytest.raises(RuntimeError):
            log.merge(spark, path, everything=True)
        assert len(log.manifest(spark, path)[1]) == 3
    else:
        assert log.merge(spark, path, everything=True) is None and len(log.manifest(spark, path)[1]) == 1
    assert state(spark, path) == before and len(before) == 3
