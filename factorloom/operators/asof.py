"""As-of join: for every left row the right row of its key that is the latest at or before its time.

Both sides become one union, dealt into ranges of (key, time) and sorted, so that a key of very many rows spans many
tasks and no pair is ever compared. A task carries the last right row on through its range; what a key had in earlier
ranges, a row a border, is broadcast and fills the rows before the range's first right row of that key.

Defined cases: a right row of the same time matches; of several right rows of one time the one whose columns are last in
order does. Left rows without a match, or with null key or time, keep nulls; right rows with null key or time match
nothing. Repeated left rows are matched each for itself. Key and time of the right side come back under its names; all
other names of both sides must differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.sources.scratch import stored


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range (key, is_left, l, r, range) -> its left rows, with r the last right row of their key so far;
    and, for borders, each key's last right row."""
    key, held = None, None  # the last right row before this batch, and its key
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, left, rights = b.column("key"), b.column("is_left").to_numpy(zero_copy_only=False), b.column("r")
        names = keys.to_pylist()
        changed = np.array([True, *(x != y for x, y in zip(names, names[1:]))])
        start = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
        last = np.maximum.accumulate(np.where(left, -1, np.arange(n)))
        at = np.where(last >= start, last, -1)
        own = rights.take(pa.array(np.where(at >= 0, at, 0), mask=at < 0))
        if held is not None and names[0] == key:  # the key goes on from the batch before
            open_rows = (at < 0) & (start == 0)
            both = pa.concat_arrays([own, held])
            own = both.take(pa.array(np.where(open_rows, n, np.arange(n))))
        known = np.array(own.is_valid())
        sent = np.flatnonzero(left)
        ends = np.flatnonzero(np.append(changed[1:], True) & known & np.array(keys.is_valid()))  # the last row of each key here
        pick = pa.array(np.concatenate((sent, ends)))
        marks = pa.array(np.concatenate((np.ones(len(sent), bool), np.zeros(len(ends), bool))))
        yield pa.record_batch([keys.take(pick), marks, b.column("l").take(pick), own.take(pick), b.column("range").take(pick)], ["key", "is_left", "l", "r", "range"])
        key, held = names[-1], own.slice(n - 1, 1) if known[-1] else None


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """left with the columns of the latest right row of the same key at or before left_time; right's key is dropped."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash or left_time == right_time:
        raise ValueError(f"columns of both sides: {sorted(clash | {left_time} & {right_time})}")
    l_kind, r_kind = left.schema, T.StructType([f for f in right.schema.fields if f.name != key])
    whole = lambda df, kind: F.struct(*[F.col(f"`{f.name}`") for f in kind.fields])
    lefts = left.select(F.col(key).alias("key"), F.col(left_time).alias("time"), F.lit(True).alias("is_left"), whole(left, l_kind).alias("l"), F.lit(None).cast(r_kind).alias("r"))
    rights = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("key"), F.col(right_time).alias("time"), F.lit(False).alias("is_left"), F.lit(None).cast(l_kind).alias("l"), whole(right, r_kind).alias("r"))
    spread = F.xxhash64("l", "r").alias("spread")  # so that equal keys and times may span ranges
    both = lefts.unionByName(rights).select("*", spread)
    dealt = both.repartitionByRange("key", "time", "is_left", "r", "spread").sortWithinPartitions("key", "time", "is_left", "r", "spread").select("key", "is_left", "l", "r", F.spark_partition_id().alias("range"))
    schema = T.StructType([T.StructField("key", left.schema[key].dataType), T.StructField("is_left", T.BooleanType()), T.StructField("l", l_kind), T.StructField("r", r_kind), T.StructField("range", T.IntegerType())])
    found = stored(dealt.mapInArrow(carried, schema), "asof")
    lasts = found.filter("not is_left").groupBy("key", "range").agg(F.max(F.struct(F.col(f"r.`{right_time}`").alias("time"), "r")).alias("m")).select("key", "range", "m.r")
    # only a range's first key can have rows in earlier ranges: a row a range
    first = found.groupBy("range").agg(F.min("key").alias("key")).filter("key is not null")
    spanning = lasts.join(F.broadcast(first.select("key").distinct()), "key", "left_semi").unionByName(first.join(lasts.select("key", "range"), ["key", "range"], "left_anti").select("key", "range", F.lit(None).cast(r_kind).alias("r")))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    borders = spanning.select("key", "range", F.last("r", ignorenulls=True).over(earlier).alias("before")).filter("before is not null")
    matched = found.filter("is_left").join(F.broadcast(borders), ["key", "range"], "left")
    timed = F.col(f"l.`{left_time}`").isNotNull()
    r = F.when(timed, F.coalesce("r", "before"))
    return matched.select("l.*", r.alias("r")).select(*[F.col(f"`{f.name}`") for f in l_kind.fields], *[F.col(f"r.`{f.name}`").alias(f.name) for f in r_kind.fields])
