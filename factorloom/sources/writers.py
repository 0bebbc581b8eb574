"""Writers: CSV, JSON lines, reports, vectors, debug samples and an HTML page."""

from __future__ import annotations

import html
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    """One JSON line a row, UTF-8, added to what is there as new files, which readers.history puts in order by_time."""
    df.write.mode("append").json(path)


def report(results: DataFrame) -> DataFrame:
    """feature, document: each result as JSON, without its season map."""
    return results.select("feature", F.to_json(F.struct(*[c for c in results.columns if c != "season_ic"])).alias("document"))


def write_reports(results: DataFrame, path: str) -> None:
    """A folder of reports by feature."""
    report(results).write.mode("overwrite").partitionBy("feature").text(path)


def vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """chunk_id, embedding and more as Parquet: an exact index needs no other structure."""
    df.write.mode(mode).parquet(path)


def debug_sample(batches: DataFrame, path: str, n: int) -> None:
    """The first n batches' prompts, replies and scores."""
    batches.filter(F.col("batch") < n).write.mode("overwrite").json(path)


def checkpoint(state: dict, path: str) -> None:
    """A small driver-side JSON file, replaced whole."""
    part = Path(f"{path}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(json.dumps(state, ensure_ascii=False))
    os.replace(part, path)


def page(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A self-contained HTML page of the first rows of small result tables."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table border=1><tr>{head}</tr>{rows}</table>")
    return "\n".join(parts)


def bars(df: DataFrame, label: str, value: str, width: int = 300, most: int = 50) -> str:
    """An SVG bar chart of a small table, negative bars to the left."""
    rows = [(str(r[0]), float(r[1] or 0)) for r in df.select(label, value).limit(most).collect()]
    top = max([abs(v) for _, v in rows] or [1.0]) or 1.0
    bar = lambda v: f'<rect x="{width / 2 + min(v, 0) / top * width / 2:.1f}" y="2" height="12" width="{abs(v) / top * width / 2:.1f}"/>'
    body = "".join(f'<g transform="translate(0,{18 * k})">{bar(v)}<text x="{width + 5}" y="12">{html.escape(n)} {v:+.4f}</text></g>' for k, (n, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 200}" height="{18 * len(rows)}">{body}</svg>'
