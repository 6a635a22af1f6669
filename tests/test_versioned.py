"""Versioned tables: writers at once, writers that die, readers meanwhile."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from plumbline.sources.versioned import Conflict, VersionedTable


def rows(spark, ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def ids(table, version=None):
    return sorted(r.id for r in table.read(version).collect())


def test_appends_add_each_key_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.append(rows(spark, [1, 2, 2]), ["id"]) == 1 and t.append(rows(spark, [2, 3]), ["id"]) == 2
    assert t.append(rows(spark, [1, 2, 3]), ["id"]) == 2 and ids(t) == [1, 2, 3] and ids(t, 1) == [1, 2]
    assert t.compact() == 3 and ids(t) == [1, 2, 3] and len(t.manifest()["parts"]) == 1 and t.compact() == 3
    assert [(r.version, r.parts) for r in t.history().orderBy("version").collect()] == [(1, 1), (2, 2), (3, 1)]


def test_two_writers_at_once_lose_and_double_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"file:{tmp_path}/t")
    parts = [range(0, 40), range(20, 60), range(10, 30), range(50, 80), range(0, 80, 3)]
    with ThreadPoolExecutor(5) as pool:
        versions = list(pool.map(lambda x: VersionedTable(spark, t.path).append(rows(spark, x), ["id"]), parts))
    assert ids(t) == list(range(80)) and max(versions) == t.versions()[-1] == len(t.versions())


def test_the_loser_takes_out_what_the_winner_brought(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    commit, raced = VersionedTable.commit, []

    def late(self, version, parts, **note):
        if not raced:
            raced.append(1)
            commit(self, version, [self.stage(rows(spark, [2, 3]))])
        commit(self, version, parts, **note)

    monkeypatch.setattr(VersionedTable, "commit", late)
    assert t.append(rows(spark, [1, 2]), ["id"]) == 2 and ids(t) == [1, 2, 3] and ids(t, 1) == [2, 3]


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, [1]), ["id"])
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.append(rows(spark, [1, 2]), ["id"])
    assert ids(t) == [1] and t.versions() == [1]
    assert t.append(rows(spark, [1, 2]), ["id"]) == 2 and ids(t) == [1, 2]


def test_a_version_is_committed_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    part = t.stage(rows(spark, [1]))
    t.commit(0, [part])
    with pytest.raises(Conflict):
        t.commit(0, [])
    assert t.manifest()["parts"] == [part] and [p.name for p in (tmp_path / "t" / "_versions").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_snapshots_replace_and_stay_readable(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.publish(rows(spark, [1, 2])) == 1
    before = t.read()
    assert t.publish(rows(spark, [3]), reason="new") == 2
    assert sorted(r.id for r in before.collect()) == [1, 2] and ids(t) == [3] and ids(t, 1) == [1, 2] and t.manifest()["note"] == {"reason": "new"}
