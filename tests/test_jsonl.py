"""JSON Lines scans and writers on lines that are good, broken, blank and odd."""

from __future__ import annotations

import json

import pytest

from plumbline.sources import folders, jsonl

GOOD = {"id": "a", "feature": "F1", "subtask": "s", "split": "test", "visibility": "public", "labels": ["yes", "no"], "expected": "yes", "state": {"text": "some text"}}


def lines_of(tmp_path, rows) -> str:
    (tmp_path / "in").mkdir()
    text = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows)
    (tmp_path / "in" / "a.jsonl").write_bytes(text.encode())
    return str(tmp_path / "in")


def test_problems_one_by_one(spark, tmp_path):
    bad = {
        "no id": {"id": ""}, "no feature": {"feature": None}, "no subtask": {"subtask": ""}, "bad split": {"split": "train"}, "bad visibility": {"visibility": "secret"}, "empty labels": {"labels": []},
        "expected not in labels": {"expected": "maybe"}, "empty text": {"state": {"text": ""}}, "bad span": {"spans": [{"start": 3, "end": 3, "label": "X"}]},
        "distribution keys": {"expected_distribution": {"yes": 1.0}}, "distribution sum": {"expected_distribution": {"yes": 0.5, "no": 0.6}},
    }
    fine = [{}, {"expected": None}, {"spans": [{"start": 0, "end": 9, "label": "X"}]}, {"expected_distribution": {"yes": 0.25, "no": 0.75}}, {"unknown": 1}]
    rows = [GOOD | {"id": name} | change for name, change in bad.items()] + [GOOD | {"id": f"ok{k}"} | change for k, change in enumerate(fine)] + ["{broken", "", "   ", '"a string"', "[1, 2]"]
    found = jsonl.read_tolerant(spark, lines_of(tmp_path, rows)).collect()
    assert len(found) == len(bad) + len(fine) + 3
    assert {r.problem for r in found if r.id in bad or r.id == ""} == set(bad)
    assert {r.problem for r in found if r.id and r.id.startswith("ok")} == {None}
    assert sum(r.problem == "not json" for r in found) == 3


def test_only_newlines_end_lines(spark, tmp_path):
    text = "one two\u0085three\rfour"
    found = jsonl.read_records(spark, lines_of(tmp_path, [GOOD | {"state": {"text": text}}])).collect()
    assert len(found) == 1 and found[0].state.text == text


def test_strict_scan_and_writer_refuse(spark, tmp_path):
    path = lines_of(tmp_path, [GOOD, GOOD | {"id": "b", "split": "train"}])
    with pytest.raises(Exception, match="bad split"):
        jsonl.read_records(spark, path).collect()
    rows = jsonl.read_tolerant(spark, path).drop("problem", "line", "file")
    with pytest.raises(Exception, match="bad split"):
        jsonl.write_records(rows, str(tmp_path / "refused"))
    for how in ("none", "gzip"):
        jsonl.write_records(rows.where("id = 'a'"), str(tmp_path / how), how)
        assert [r.asDict(True) for r in jsonl.read_records(spark, str(tmp_path / how)).collect()] == [r.asDict(True) for r in rows.where("id = 'a'").collect()]


def test_raw_lines_of_any_shape(spark, tmp_path):
    found = jsonl.read_raw(spark, lines_of(tmp_path, [{"a": {"b": [1, 2]}}, "nonsense{", "3"])).selectExpr("try_variant_get(value, '$.a.b[1]', 'int') as x", "value is null as missing").collect()
    assert sorted((r.x or 0, r.missing) for r in found) == [(0, False), (0, True), (2, False)]


def test_empty_inputs(spark, tmp_path):
    path = lines_of(tmp_path, [])
    assert jsonl.read_tolerant(spark, path).count() == jsonl.read_records(spark, path).count() == jsonl.read_raw(spark, path).count() == 0


def test_published_folders_and_ledgers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        folders.published_folder(spark, str(tmp_path / "none"))
    spark.range(3).write.parquet(str(tmp_path / "s" / "v9"))
    spark.range(3).write.parquet(str(tmp_path / "s" / "v10"))
    (tmp_path / "s" / "v11").mkdir()
    assert folders.published_folder(spark, str(tmp_path / "s")).endswith("v10")
    with pytest.raises(KeyError):
        folders.load(spark, "nowhere", "")
