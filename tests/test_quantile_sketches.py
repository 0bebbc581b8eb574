import os
from pathlib import Path

import numpy as np
import pytest

from factorloom.operators import panel
from factorloom.operators import quantile_sketches as q

YEARS = [2001, 2002]


def rows(seed, n):
    """Skewed, tied and few values, nulls, other years; feature names that sort apart."""
    rng = np.random.default_rng(seed)
    out = [("normal", int(y), float(v)) for y, v in zip(rng.integers(2000, 2004, n), rng.normal(size=n))]
    out += [("tied", 2001, float(v)) for v in rng.integers(-2, 3, n)]
    return out + [("few", 2002, float(seed)), ("few", 2001, None), ("other", 1990, 1.0), ("none", 2001, None)]


def add(spark, path, part):
    spark.createDataFrame(part, q.ROWS).coalesce(1).write.mode("append").parquet(path)


def as_dict(df):
    return {r.feature: (pytest.approx(r.low, abs=1e-12), pytest.approx(r.high, abs=1e-12)) for r in df.collect()}


def values(df):
    return {r.feature: (r.low, r.high) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return q.SketchStore(spark, f"file://{tmp_path}/sketches", f"file://{tmp_path}/data", YEARS)


def test_bounds_of_a_growing_panel(spark, tmp_path, store):
    assert store.update() == [] and store.bounds().collect() == [] and store.near().collect() == []
    everything = []
    for seed in (1, 2):
        part = rows(seed, 4000)
        everything += part
        add(spark, store.data, part)
        assert len(store.update()) == 1 and store.update() == []
        wanted = panel.winsor_bounds(spark.createDataFrame(everything, q.ROWS), YEARS)
        assert values(store.bounds()) == as_dict(wanted) and set(values(wanted)) == {"normal", "tied", "few"}
    near = values(store.near())
    assert abs(near["normal"][0] - values(wanted)["normal"][0]) < 0.2


def test_only_new_files_are_read(spark, tmp_path, store):
    """A file that has its sketch may turn unreadable: the update doesn't open it, nor do bounds by sketches alone."""
    add(spark, store.data, rows(1, 500))
    first = store.update()
    for f in Path(tmp_path / "data").glob("*.parquet"):
        f.write_bytes(b"unreadable")
    for f in Path(tmp_path / "data").glob(".*.crc"):
        os.unlink(f)
    add(spark, store.data, rows(2, 500))
    assert len(store.update()) == 1 and store.read != first
    assert {r.feature: r.n for r in store.merged().collect()}["tied"] == 1000 and set(values(store.near())) == {"normal", "tied", "few"}


def test_missed_brackets_are_noticed(spark, store, monkeypatch):
    """With brackets of no width, sketches of a few values miss, and the features are ordered whole."""
    part = rows(3, 4000)
    add(spark, store.data, part)
    monkeypatch.setattr(q, "NEAR", 0.0)
    monkeypatch.setattr(q, "K", 8)
    store.update()
    assert values(store.bounds()) == as_dict(panel.winsor_bounds(spark.createDataFrame(part, q.ROWS), YEARS))
