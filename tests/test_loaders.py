"""Loaders as a data source: ranges, filters, limits, hooks."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from plumbline.sources import loaders


def lines_in(folder, files=3, n=50):
    rng, rows = random.Random(1), []
    folder.mkdir()
    for k in range(files):
        mine = [{"id": 100 * k + i, "split": rng.choice(["dev", "test"]), "source": "s", "expected": rng.choice(["YES", "no", None]), "text": "zeile é " * rng.randrange(30) + "\nmore"} for i in range(n)]
        (folder / f"part-{k}.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in mine) + ("" if k == 1 else "\n\n"), encoding="utf-8")
        rows += mine
    (folder / "_SUCCESS").write_text("")
    return rows


@pytest.mark.parametrize("size", [1, 7, 300, 1 << 20])
def test_every_line_is_read_once(spark, tmp_path, size):
    rows = lines_in(tmp_path / "in", n=20 if size < 10 else 50)
    reader = loaders.LinesReader({"path": str(tmp_path / "in"), "rangeBytes": str(size)})
    got = [json.loads(x)["id"] for p in reader.partitions() for x in loaders.lines(p) if x.strip()]
    assert got == [r["id"] for r in rows]


def test_records_through_spark(spark, tmp_path):
    rows = lines_in(tmp_path / "in")
    df = loaders.load(spark, "labelled", str(tmp_path / "in"), range_bytes=500)
    assert df.rdd.getNumPartitions() > 10 if hasattr(df, "rdd") else True
    want = {r["id"]: r["expected"].lower() for r in rows if r["expected"]}
    assert {r.id: r.expected for r in df.collect()} == want
    dev = df.where((F.col("split") == "dev") & (F.col("id") > 20))
    assert {r.id for r in dev.collect()} == {r["id"] for r in rows if r["expected"] and r["split"] == "dev" and r["id"] > 20}
    first = loaders.load(spark, "prompts", f"file:{tmp_path}/in/part-0.jsonl", limit=7)
    assert [r.id for r in first.collect()] == list(range(7)) and all("\n" not in r.text for r in first.collect())
    (tmp_path / "none").mkdir()
    assert loaders.load(spark, "plain", str(tmp_path / "none")).count() == 0


def test_filters_and_limits_reach_the_reader(tmp_path):
    rows = lines_in(tmp_path / "in", files=1)
    reader = loaders.LinesReader({"path": str(tmp_path / "in"), "limit": "3"})
    left = list(reader.pushFilters([EqualTo(("split",), "dev"), GreaterThan(("id",), 5), EqualTo(("split",), "test"), EqualTo(("other",), 1)]))
    assert reader.equal == {"split": "dev"} and len(left) == 3
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["id"] for r in got] == [r["id"] for r in rows if r["split"] == "dev"][:3]
    with pytest.raises(KeyError):
        loaders.LinesReader({"path": "x", "suite": "nowhere"})
    with pytest.raises(ValueError):
        loaders.to_record("plain")(lambda raw: raw)
