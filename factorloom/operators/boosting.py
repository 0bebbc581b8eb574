"""Gradient-boosted regression trees by histograms, with L1 and L2 penalties on leaves.

Columns are cut into at most BINS quantile bins once. Rows of equal bins, a cell, always have one prediction, so a cell
keeps its number of rows and the sum of their labels only: few columns have few cells, however many rows there are. Cells
are stored as blocks of bytes. A tree grows leaf by leaf, the leaf
of most gain first; each job adds up the gradients' sums and counts by leaf, column and bin in its tasks, so that a few
thousand numbers a task reach the driver, whatever the number of rows. Where the depth limit alone decides the leaves,
all leaves of a level are split after one job. Blocks keep each cell's prediction as of the last fold; trees since then
are evaluated in the tasks, and every FOLD trees the predictions are brought up to date and checkpointed. Up to PART cells
are boosted in one task, by the same steps.

For a leaf of n rows whose gradients (prediction less label) add up to G, with T(G) = sign(G) max(|G| - l1, 0): its value
is -rate T(G) / (n + l2), its score T(G)^2 / (n + l2), and a split gains what its two leaves score more than their
parent. Equal gains go to the first column, then the lowest cut.

Defined cases: missing values are 0; rows without a label don't teach; without rows that teach every prediction is 0. A
column of one value is never split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.sources.scratch import shared_dir, stored

BINS, FOLD = 255, 20
#: Partial results that the driver adds up itself; more are added up in tasks first.
PARTIAL = 64
#: Cells that one task boosts alone, as 600 jobs would take longer to start than to run.
PART = 100_000
#: Cells of a block.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.02
    leaves: int = 16
    depth: int = 3
    least: int = 40
    l1: float = 0.5
    l2: float = 2.0
    columns: float = 0.7
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: column, bin (rows of it and below go left), left child (the right one follows), value of a leaf."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int, gain: float, values: tuple[float, float]) -> int:
        """The left one of a node's new children."""
        left = len(self.column)
        self.column[node], self.cut[node], self.left[node], self.gain[node] = column, cut, left, gain
        for value in values:
            self.column.append(-1)
            self.cut.append(-1)
            self.left.append(-1)
            self.value.append(value)
            self.gain.append(0.0)
        return left

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (columns x rows)."""
        at = np.zeros(bins.shape[1], np.int32)
        for node, column in enumerate(self.column):  # children have larger numbers than their parents
            if column >= 0:
                here = at == node
                at[here] = self.left[node] + (bins[column][here] > self.cut[node])
        return at

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(bins)]


@dataclass
class Model:
    names: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def binned(self, values: list[np.ndarray]) -> np.ndarray:
        return binned(values, self.edges)

    def predict(self, values: list[np.ndarray]) -> np.ndarray:
        bins = self.binned(values)
        return self.base + sum((t.values_of(bins) for t in self.trees), np.zeros(bins.shape[1]))

    def importance(self) -> list[tuple[str, float]]:
        """Columns by the gain of their splits."""
        total = np.zeros(len(self.names))
        for t in self.trees:
            for column, gain in zip(t.column, t.gain):
                if column >= 0:
                    total[column] += gain
        return sorted(zip(self.names, total.tolist()), key=lambda x: (-x[1], x[0]))


def binned(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Columns x rows of bins: the number of edges below a value."""
    return np.stack([np.searchsorted(e, v, "left").astype(np.uint8) for v, e in zip(values, edges)]) if values else np.empty((0, 0), np.uint8)


def filled(names: list[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names]


def quantile_edges(rows: DataFrame, names: list[str], most: int = BINS) -> list[np.ndarray]:
    """Cuts between bins, values at quantiles: rows up to a cut lie below it. A column of few values has them all."""
    shares = [k / most for k in range(1, most)]
    found = rows.agg(*[F.percentile_approx(n, shares, 100 * most).alias(n) for n in names], *[F.max(n).alias(f"__most_{k}") for k, n in enumerate(names)]).first()
    out = []
    for k, n in enumerate(names):
        cuts = np.unique(np.array(found[n] or [], float))
        out.append(cuts[cuts < found[f"__most_{k}"]] if found[f"__most_{k}"] is not None else cuts)
    return out


def shrunk(g: np.ndarray | float, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, counts: np.ndarray, columns: list[int], s: Settings) -> tuple | None:
    """(gain, column, bin, G and n of both sides) of a leaf's histograms (columns x bins), or None if none gains."""
    best = None
    for c in columns:
        g, n = np.cumsum(sums[c]), np.cumsum(counts[c])
        total, rows = g[-1], n[-1]
        left, right = n[:-1], rows - n[:-1]
        score = lambda x, k: shrunk(x, s.l1) ** 2 / (k + s.l2)
        gain = np.where((left >= s.least) & (right >= s.least), score(g[:-1], left) + score(total - g[:-1], right) - score(total, rows), -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > 1e-12 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), c, k, (float(g[k]), int(left[k])), (float(total - g[k]), int(right[k])))
    return best


def grow(histograms: Callable[[Tree, list[int]], tuple[np.ndarray, np.ndarray]], columns: list[int], s: Settings) -> Tree:
    """One tree. histograms gives the sums and counts (leaves x columns x bins) of a tree's given leaves."""
    tree, depth, found, asked = Tree(), {0: 0}, {}, [0]
    value = lambda side: -s.rate * float(shrunk(side[0], s.l1)) / (side[1] + s.l2)
    leaves, by_depth = 1, 2**s.depth <= s.leaves
    while True:
        if asked:
            for node, g, n in zip(asked, *histograms(tree, asked)):
                found[node] = best_split(g, n, columns, s)
                if node == 0:
                    tree.value[0] = value((g[columns[0]].sum(), n[columns[0]].sum()))
        ready = sorted((node for node, b in found.items() if b), key=lambda node: (-found[node][0], node))[: s.leaves - leaves]
        if not ready:
            return tree
        asked = []
        for node in ready if by_depth else ready[:1]:
            gain, column, cut, *sides = found.pop(node)
            left = tree.split(node, column, cut, gain, tuple(map(value, sides)))
            leaves += 1
            for child, (_, n) in zip((left, left + 1), sides):
                depth[child] = depth[node] + 1
                if depth[child] < s.depth and n >= 2 * s.least:
                    asked.append(child)


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # cells' bins, sums of labels, rows, predictions as of the last fold


def block_histograms(blocks: Iterator[Block], since: list[Tree], tree: Tree, leaves: list[int], n_bins: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of gradients and counts of a partition's rows."""
    sums = counts = None
    place = np.full(len(tree.column), -1)
    place[leaves] = np.arange(len(leaves))
    for bins, labels, rows, before in blocks:
        g = rows * sum((t.values_of(bins) for t in since), before) - labels
        at = place[tree.leaves_of(bins)]
        inside = at >= 0
        if sums is None:
            sums, counts = np.zeros((len(leaves), len(bins), n_bins)), np.zeros((len(leaves), len(bins), n_bins), np.int64)
        for c in range(len(bins)):
            key = at[inside] * n_bins + bins[c][inside]
            sums[:, c] += np.bincount(key, g[inside], len(leaves) * n_bins).reshape(-1, n_bins)
            counts[:, c] += np.bincount(key, rows[inside], len(leaves) * n_bins).astype(np.int64).reshape(-1, n_bins)
    if sums is not None:
        yield sums, counts


def cells_of(rows: DataFrame, names: list[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    """cell (a byte a column), n, labels of every combination of bins that rows have, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binned([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))], edges)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(names)
            cells = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(bins.T.tobytes())])
            yield pa.record_batch([cells, b.column(len(names))], ["cell", "label"])

    found = rows.select(*filled(names), F.col(label).cast("double").alias("__label")).mapInArrow(run, "cell binary, label double")
    return stored(found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels")), "cells")


def as_blocks(cells: DataFrame, d: int, base: float) -> RDD:
    """Stored blocks of cells of d columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins = np.frombuffer(b"".join(t.column("cell").to_pylist()), np.uint8).reshape(-1, d).T
            return pa.record_batch([pa.array([x]) for x in (bins.tobytes(), t.column("labels").to_numpy().tobytes(), t.column("n").to_numpy().astype(float).tobytes())], ["bins", "labels", "n"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    blocks = stored(cells.select("cell", "labels", "n").mapInArrow(run, "bins binary, labels binary, n binary"), "blocks")

    def unpacked(r) -> Block:
        labels = np.frombuffer(r.labels, float)
        return np.frombuffer(r.bins, np.uint8).reshape(d, len(labels)), labels, np.frombuffer(r.n, float), np.full(len(labels), base)

    return blocks.rdd.map(unpacked)


class Shared:
    """Blocks in many tasks: a job a level, and the trees since the last fold evaluated in the tasks."""

    def __init__(self, blocks: RDD, n_bins: int):
        self.blocks, self.n_bins, self.since = blocks.persist(StorageLevel.MEMORY_AND_DISK), n_bins, []

    def histograms(self, tree: Tree, leaves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        recent, n_bins = list(self.since), self.n_bins
        parts = self.blocks.mapPartitions(lambda x: block_histograms(x, recent, tree, leaves, n_bins))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1])
        return parts.treeReduce(add) if parts.getNumPartitions() > PARTIAL else parts.reduce(add)

    def add(self, tree: Tree) -> None:
        self.since.append(tree)
        if len(self.since) == FOLD:
            recent, old = self.since, self.blocks
            self.blocks, self.since = old.map(lambda b: (*b[:3], sum((t.values_of(b[0]) for t in recent), b[3]))).persist(StorageLevel.MEMORY_AND_DISK), []
            self.blocks.checkpoint()
            self.blocks.count()
            old.unpersist()


class Own:
    """The blocks of one task, with their predictions up to date."""

    def __init__(self, blocks: list[Block], n_bins: int):
        self.blocks, self.n_bins = blocks, n_bins

    def histograms(self, tree: Tree, leaves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [next(block_histograms(iter([b]), [], tree, leaves, self.n_bins)) for b in self.blocks]
        return sum(g for g, _ in parts), sum(n for _, n in parts)

    def add(self, tree: Tree) -> None:
        self.blocks = [(*b[:3], b[3] + tree.values_of(b[0])) for b in self.blocks]


def boost(data: Shared | Own, n_columns: int, s: Settings) -> list[Tree]:
    random, trees = np.random.default_rng(s.seed), []
    for _ in range(s.rounds):
        some = sorted(random.choice(n_columns, max(1, round(s.columns * n_columns)), replace=False).tolist())
        trees.append(grow(data.histograms, some, s))
        data.add(trees[-1])
    return trees


def fit(rows: DataFrame, names: list[str], label: str, settings: Settings = Settings()) -> Model:
    """The model of rows with a label. Up to PART cells are boosted in one task, more of them by a job a level."""
    taught = rows.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(*filled(names), F.col(label).cast("double").alias(label))
    taught = stored(taught, "taught")  # read three times
    base, n = taught.agg(F.avg(label), F.count(F.lit(1))).first()
    if not n:
        return Model(names, [np.empty(0)] * len(names), 0.0, [])
    shared_dir(rows.sparkSession)  # where checkpoints go
    edges = quantile_edges(taught, names)
    n_bins, d = max(1, *(len(e) for e in edges)) + 1, len(names)
    cells = cells_of(taught, names, label, edges)
    blocks = as_blocks(cells, d, base)
    if cells.count() <= PART:
        return Model(names, edges, base, blocks.coalesce(1).mapPartitions(lambda x: boost(Own(list(x), n_bins), d, settings)).collect())
    data = Shared(blocks, n_bins)
    trees = boost(data, d, settings)
    data.blocks.unpersist()
    return Model(names, edges, base, trees)


def predicted(table: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    """table with the model's prediction."""

    @F.pandas_udf("double")
    def of(values: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict([values[c].to_numpy(float) for c in values.columns]))

    columns = [c.alias(f"c{k}") for k, c in enumerate(filled(model.names))]
    return table.withColumn(name, of(F.struct(*columns)))
