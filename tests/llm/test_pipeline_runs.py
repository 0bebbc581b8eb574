import importlib
from concurrent.futures import ThreadPoolExecutor

import pytest


@pytest.fixture
def folders(spark, docs, tmp_path):
    rows = docs.limit(60)
    for k in range(2):
        rows.filter(f"doc_id % 3 <> {k}").coalesce(2).write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string").write.parquet(str(tmp_path / f"{k}" / "benchmark.parquet"))
    return [str(tmp_path / f"{k}") for k in range(2)]


def rows_of(df):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())


def test_two_runs_in_threads_and_stages_by_turns(spark, folders):
    """Runs side by side, in threads or stage by stage in one, don't drop each other's tables."""
    p = importlib.import_module("corpus_pipeline")
    want = [rows_of(p.run(spark, f)) for f in folders]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda f: rows_of(p.run(spark, f)), folders)) == want
    current = [spark.read.parquet(f"{f}/documents.parquet") for f in folders]
    for k, (name, stage) in enumerate(p.STAGES):
        found = [stage(spark, d, f) for d, f in zip(current, folders)]
        if k == len(p.STAGES) - 1:
            assert [rows_of(d) for d in found] == want
            break
        current = []
        for d, f in zip(found, folders):
            d.write.parquet(f"{f}/{name}")
            current.append(spark.read.parquet(f"{f}/{name}"))


def test_packing_leaves_no_words_in_workers(spark, folders):
    """Worker processes outlive the last stage; the next run's stages need the memory."""
    p = importlib.import_module("corpus_pipeline")

    def held(clear):
        def run(batches):
            import time

            import pyarrow as pa

            from factorloom.llm.packing import ENCODERS

            time.sleep(0.3)  # so that every worker gets a task
            for _ in batches:
                yield pa.record_batch([pa.array([len(ENCODERS)], pa.int32())], ["n"])
            if clear:
                ENCODERS.clear()

        return sum(r.n for r in spark.range(0, 8, 1, 8).mapInArrow(run, "n int").collect())

    held(True)
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    assert p.pack(spark, docs, folders[0]).count() > 0 and held(False) == 0
