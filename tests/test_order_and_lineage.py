"""Line order over files and splits, and lineages of any depth."""

import json
import os
import random

import pytest

from factorloom.operators import history as h
from factorloom.sources import readers, writers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, name, names):
    (folder / name).write_text("".join(json.dumps({"feature_spec": {"feature_name": n}}) + "\n" if n else "\n" for n in names))


def test_lines_are_in_order_over_files_and_splits(spark, tmp_path, small_splits):
    """A small file by name before a large one, blank lines, many splits a file, and a re-read."""
    large = [f"b{k}" if k % 7 else "" for k in range(200)]
    write(tmp_path, "a.jsonl", ["a0", "a1"])
    write(tmp_path, "b.jsonl", large)
    write(tmp_path, "c.jsonl", ["c0"])
    want = [(k, n) for k, n in enumerate(["a0", "a1", *large, "c0"]) if n]
    for _ in range(2):
        df = readers.history(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        got = sorted((r.line_no, json.loads(r.feature_spec)["feature_name"]) for r in df.collect())
        assert got == want
    write(tmp_path, "d.jsonl", ["d0"])
    assert readers.history(spark, str(tmp_path)).filter("line_no = 203").first().feature_spec == '{"feature_name":"d0"}'


def test_last_wins_over_files(spark, tmp_path, small_splits):
    """The last patch, the first spec and the last record are those of the later and earlier file, whichever is read first."""
    (tmp_path / "a.jsonl").write_text(json.dumps({"_patch_feature": "f", "diagnosis": {"cause": "old"}}) + "\n")
    lines = [json.dumps({"feature_spec": {"feature_name": "f"}, "pad": "x" * 50})] * 40 + [json.dumps({"_patch_feature": "f", "diagnosis": {"cause": "new"}})]
    (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\n")
    log = readers.history(spark, str(tmp_path))
    patches = log.filter("kind = 'patch'").selectExpr("_patch_feature AS feature", "diagnosis", "line_no")
    specs = log.filter("kind = 'feature'").selectExpr("get_json_object(feature_spec, '$.feature_name') AS feature", "line_no")
    assert h.patched(h.first_by(specs, "feature"), patches).first().diagnosis == '{"cause":"new"}'
    assert h.first_by(specs, "feature").first().line_no == 1 and h.last_by(specs, "feature").first().line_no == 40


def test_appended_files_are_in_order_of_time(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(4):
        writers.append_json(spark.createDataFrame([({"feature_name": f"n{k}"},)], "feature_spec map<string,string>").coalesce(1), path)
        for name in os.listdir(path):
            if name.endswith(".json") and os.stat(f"{path}/{name}").st_mtime > 10**9:
                os.utime(f"{path}/{name}", (1000 + k, 1000 + k))
    got = [json.loads(r.feature_spec)["feature_name"] for r in readers.history(spark, path, by_time=True).orderBy("line_no").collect()]
    assert got == ["n0", "n1", "n2", "n3"]


def test_files_of_one_schema_are_one_scan(spark, tmp_path):
    for k in range(6):
        df = spark.range(k, k + 1).selectExpr("id", "id AS x") if k != 3 else spark.range(1)
        df.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    with pytest.warns(UserWarning, match="p3"):
        df = readers.files_with(spark, [str(tmp_path / f"p{k}") for k in range(6)], ["id", "x"])
    assert sorted(r.x for r in df.collect()) == [0, 1, 2, 4, 5] and df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def walked(of, name):
    seen = [name]
    while of.get(seen[-1]) in of:
        if of[seen[-1]] in seen:
            return None, None, True
        seen.append(of[seen[-1]])
    return seen[-1], len(seen) - 1, False


@pytest.mark.parametrize("seed", range(3))
def test_lineage_roots(spark, seed):
    """Chains, bushes, cycles and what hangs below them, parents that aren't recorded, and repeated records."""
    r = random.Random(seed)
    of = {f"c{k}": f"c{k - 1}" if k else None for k in range(130)}
    of |= {f"t{k}": f"t{r.randint(0, k - 1)}" if k else "gone" for k in range(60)}
    of |= {"x0": "x2", "x1": "x0", "x2": "x1", "x3": "x2", "x4": "x3", "self": "self", "below": "self"}
    rows = [(k, n, p) for k, (n, p) in enumerate(of.items())] + [(9000, "c5", "x0")]
    r.shuffle(rows)
    got = {x.feature: (x.root, x.depth, x.cyclic) for x in h.lineage_roots(spark.createDataFrame(rows, "line_no long, feature string, repair_of string")).collect()}
    assert got == {n: walked(of, n) for n in of}


def test_lineage_of_nothing(spark):
    assert h.lineage_roots(spark.createDataFrame([], "line_no long, feature string, repair_of string")).collect() == []
