"""Readers: parquet folders, panels, CSV features, history logs, vectors and paper pages."""

from __future__ import annotations

import json
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = "feature_spec string, governance_result string, _patch_feature string, diagnosis string, _repair_spec string"
TRACE = (
    "run_id string, step_id int, state string, iteration int, tool_called string, tool_args map<string,string>, tool_latency_ms double, tool_ok boolean, "
    "tool_error string, context_tokens int, observation string, decision string, timestamp string"
)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def folder(spark: SparkSession, path: str, columns: list[str], rows_per_file: int | None = None) -> DataFrame:
    """The required columns of all parquet files under path; the first rows_per_file rows of each, if set."""
    df = require(spark.read.parquet(path), columns).select(*columns, *( ["_metadata.file_path", "_metadata.row_index"] if rows_per_file else []))
    if rows_per_file is None:
        return df
    return df.filter(F.col("row_index") < rows_per_file).drop("file_path", "row_index")


def files_with(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The union of those files that have all columns; the others are skipped with a warning that names them.

    Files of one schema are one scan, so that the plan grows with the number of schemas, not of files.
    """
    by_schema: dict[str, list[str]] = {}
    for p in sorted(paths):
        by_schema.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    scans = [(spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*some), some) for schema, some in by_schema.items()]
    good = [d.select(*columns) for d, _ in scans if set(columns) <= set(d.columns)]
    if skipped := sorted(p for d, some in scans if not set(columns) <= set(d.columns) for p in some):
        warnings.warn(f"skipped for lack of columns: {', '.join(skipped)}", stacklevel=2)
    if not good:
        raise ValueError("no file has all columns")
    return reduce(DataFrame.unionByName, good)


def event_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("earnings_date", F.to_timestamp("earnings_date"))


def symbol_sectors(spark: SparkSession, path: str) -> DataFrame:
    """Only two columns of the panel are read."""
    return spark.read.parquet(path).select("symbol", "sector")


def feature_csv(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """feature, symbol, earnings_date, value of a CSV with a column named after the feature; NaN becomes null."""
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("earnings_date", T.TimestampType()), T.StructField(feature, T.DoubleType())])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.select(F.lit(feature).alias("feature"), "symbol", "earnings_date", F.nanvl(F.col(feature), F.lit(None).cast("double")).alias("value"))


def numbered_lines(spark: SparkSession, path: str, by_time: bool = False) -> DataFrame:
    """value, file, line_no of the text files under path: line_no counts all lines, blank ones too, from 0 on, file by
    file in order of their names, or of their modification times and then names.

    A file may be read in several splits, in any order and by any task. Two passes: lines are counted by split, the
    counts of earlier splits are added up over the splits alone, and a line adds its place in its split.
    """
    meta = ["_metadata.file_modification_time AS time", "_metadata.file_path AS file", "_metadata.file_block_start AS split"]
    lines = spark.read.text(path).selectExpr("value", *meta).withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("time", "file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(*(["time"] if by_time else []), "file", "split")  # a row a split
    before = splits.select("file", "split", "first", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), ["file", "split"]).select("value", "file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"))


def history(spark: SparkSession, path: str, by_time: bool = False) -> DataFrame:
    """History lines with kind and line_no; JSON parts stay texts for from_json. Blank lines are skipped.

    line_no orders lines over all files, by name or, for a log that appends files, by time (see numbered_lines).
    """
    from factorloom.operators.history import kind_of_line

    raw = numbered_lines(spark, path, by_time).filter(F.trim("value") != "")
    parsed = raw.select("line_no", "file", F.from_json("value", HISTORY).alias("r")).select("line_no", "file", "r.*")
    return parsed.withColumn("kind", kind_of_line())


def trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def vectors(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """chunk_id, embedding and what else the index holds; vectors of another size are an error."""
    df = require(spark.read.parquet(path), ["chunk_id", "embedding"])
    return df if size is None else df.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {size} numbers"))))


def upserted(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of old and new, one for each key: the old one stays."""
    rest = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*rest).alias("row"), F.lit(0).alias("new")).unionByName(new.select(key, F.struct(*rest).alias("row"), F.lit(1).alias("new")))
    return both.groupBy(key).agg(F.min_by("row", "new").alias("row")).select(key, "row.*").select(*old.columns)


def not_yet(new: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key is not written yet: where an interrupted build goes on."""
    return new.join(done.select(key), key, "left_anti")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """paper_title, page_num, text of PDF files' pages that have text; unreadable files are skipped. Needs pypdf."""
    import pandas as pd

    def run(batches):
        import io

        from pypdf import PdfReader

        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"]):
                try:
                    texts = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]
                except Exception as e:  # one bad file must not stop the build
                    print(f"skipped {name}: {e}")
                    continue
                title = name.rsplit("/", 1)[-1].removesuffix(".pdf")
                rows += [(title, k, t) for k, t in enumerate(texts, 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["paper_title", "page_num", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "paper_title string, page_num int, text string")
