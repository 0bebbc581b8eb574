"""Exact Jaccard self-join of word-shingle sets by set-relation skipping: links, their number, components.

A document's set holds its distinct 5-word shingles. Equal sets are one class, and classes are joined:

1. Shingles below a fixed share THETA of the hash range are checked over all classes: a class of which too many are its
   own can't have a similar one. Among the classes left every shingle is counted, and they are thinned once more.
2. Answers are derived from a highly similar set's. Each class looks for a leader in the lists of its first shingles and
   keeps what sets it apart: the shingles of the leader it lacks and those it has besides. With cost = 5 lacking + 4
   besides, two followers of a leader of L shingles are similar exactly if

       cost(x) + cost(y) <= L + 9 * (differences that x and y share).

   So all pairs with cost(x) + cost(y) <= L are links, and a cumulative sum over costs counts them without a row for
   each. Only other pairs are looked for, in lists of the differences within the leader's group.
3. Classes of different groups meet in lists of their prefixes: in the order of rarity, n - ceil(0.8 n) + 1 shingles
   meet the prefix of every similar set. Lists of shingles within one group are skipped whole.
4. Lists of steps 2 and 3 are cut into blocks of like size (or cost). A class's place in a list bounds what can still
   be shared, and with it the blocks that hold possible partners: the others are skipped. A long block is split over
   tasks. What is left is settled on whole sets or differences.

All comparisons are exact on 64-bit shingle names; no link between different sets is lost and none is cut off. Shingles
of one set at a time, or some hundred thousand, are in a task's memory; no list, class or group is.

Defined cases: a text of fewer than five words is one shingle of its whole sequence; null, empty and wordless texts
have the empty set, link with nothing and are their own component, even if they are equal. Rows that repeat, or share
doc_id, are separate documents: equal ones are linked. component_id and class_id pass over null ids; they are null only
if every document of the component has none. Extra columns aren't read, but `identified` carries them along. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import U64, binary, blobs, by_bytes, mix, part_of, shingle_hashes, small_batches, stored, trim
from factorloom.llm.graph import components
from factorloom.llm.substring_dedup import _by_part, _schema

THETA, HEADS = 0.3, 24
BELOW = U64(int(THETA * 2**64))
#: Followers share this many percent of both sets' shingles with their leader at least. Any value gives the same links.
FOLLOWS = 40
#: Shingles that a task gathers or a key range holds, in expectation; rows of a list's block before it is split; ids that are broadcast.
GATHERED, SPLIT, BROADCAST = 250_000, 4096, 1_000_000
KEYS = "part int, batch long, keys binary, owners binary"
TIMES = "chunk int, part int, times binary"


def needed(n: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-4 * n // 5)


def identified(docs: DataFrame) -> DataFrame:
    """Every row once, stored: row_id, doc (its columns), the set's 128-bit name (one, two) and size, and its low shingles."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    names = ["one", "two", "size", "low"]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = pc.struct_field(whole.column("doc"), "text").cast(pa.string())
            for b in by_bytes(whole.append_column("text", text), "text"):
                one, two, size, low = [], [], [], []
                for t in blobs(b.column("text")):
                    s = shingle_hashes(t)
                    one.append(int(mix(s, U64(3)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                    two.append(int(np.bitwise_xor.reduce(mix(s, U64(7))).view(np.int64)) if len(s) else 0)
                    size.append(len(s))
                    low.append(binary(s[: np.searchsorted(s, BELOW)]))
                columns = [pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(size, pa.int32()), pa.array(low, pa.binary())]
                yield pa.record_batch([b.column("row_id"), b.column("doc"), *columns], ["row_id", "doc", *names])

    return stored(rows.mapInArrow(run, schema), "identified")


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return part_of(keys << U64(2), parts)  # low shingles all have their top bits clear


def low_keys(parts: int):
    """Classes' low shingles -> (key, class) by key range, each key once a batch: class 0 says that the batch has several.

    Those several are counted here, in rows of part < 0 that hold classes and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent, keys, owners, gathered = TaskContext.get().partitionId(), 0, [], [], 0

        def rows() -> pa.RecordBatch:
            nonlocal sent, keys, owners, gathered
            k, o = np.concatenate(keys), np.repeat(np.array(owners, np.int64), [len(x) for x in keys])
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
            k, o = k[new], o[new]
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            several = np.diff(np.append(head, len(k))) > 1
            names, counts = np.unique(o[np.repeat(several, np.diff(np.append(head, len(k))))], return_counts=True)
            k, o = k[head], np.where(several, 0, o[head])
            batch = (task << 24) + sent
            out = [{"part": p, "batch": batch, "keys": binary(k[at]), "owners": binary(o[at])} for p, at in _by_part(_part(k, parts))]
            out.append({"part": -1 - batch % parts, "batch": batch, "keys": binary(names), "owners": binary(counts.astype(np.int64))})
            sent, keys, owners, gathered = sent + 1, [], [], 0
            trim()
            return pa.RecordBatch.from_pylist(out, _schema(KEYS))

        for b in batches:
            for name, low in zip(b.column("one").to_pylist(), b.column("low").to_pylist()):
                if low:
                    keys.append(np.frombuffer(low, U64))
                    owners.append(name)
                    gathered += len(keys[-1])
                if gathered > GATHERED:
                    yield rows()
        if keys:
            yield rows()

    return run


def shared_counts(table: pa.Table) -> pa.Table:
    """Key range -> batch, keys (classes), owners (counts): how many of a class's shingles in a batch others have."""
    if table.column("part")[0].as_py() < 0:
        return table.select(["batch", "keys", "owners"])
    keys, owners = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("keys", U64), ("owners", np.int64)))
    batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in keys])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    owners, batch, keys = owners[order], batch[order], keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    several = np.minimum.reduceat(owners, head) != np.maximum.reduceat(owners, head)
    there = np.repeat(several, np.diff(np.append(head, len(keys)))) & (owners != 0)
    owners, batch = owners[there], batch[there]
    batches, place = np.unique(batch, return_inverse=True)
    rows = []
    for k, at in _by_part(place):
        names, counts = np.unique(owners[at], return_counts=True)
        rows.append({"batch": int(batches[k]), "keys": binary(names), "owners": binary(counts.astype(np.int64))})
    del keys, owners, batch, order, there, place
    trim()
    return pa.Table.from_pylist(rows, _schema("batch long, keys binary, owners binary"))


def batch_counts(table: pa.Table) -> pa.Table:
    """Batch -> one, n: its classes' counts over all key ranges."""
    names, counts = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "owners"))
    names, place = np.unique(names, return_inverse=True)
    return pa.table([pa.array(names), pa.array(np.bincount(place, counts, len(names)).astype(np.int64))], ["one", "n"])


def ranges(df: DataFrame, shingles: Column) -> int:
    """Number of key ranges or chunks that hold GATHERED shingles each, whatever the number and length of documents."""
    total = df.agg(F.sum(shingles).alias("n")).first().n or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // GATHERED))


def candidate_sets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, copies, shingles of the classes that can have a similar one, stored."""
    full = rows.filter("size > 0").select("one", "low")
    keys = full.mapInArrow(low_keys(ranges(full, F.octet_length("low") / 8)), KEYS)
    told = keys.groupBy("part").applyInArrow(shared_counts, "batch long, keys binary, owners binary")
    # a class with copies may be in several batches: each has its whole count
    counts = told.groupBy("batch").applyInArrow(batch_counts, "one long, n long").groupBy("one").agg(F.max("n").alias("n"))
    left = classes.join(counts, "one", "left").filter("n_low - coalesce(n, 0) <= size - (4 * size + 4) div 5")
    left = stored(left.select("node", "copies"), "left")
    near = F.broadcast(left) if left.count() <= BROADCAST else left
    texts = rows.select(F.col("row_id").alias("node"), F.col("doc.text").cast("string").alias("text")).join(near, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text"):
                sets = [shingle_hashes(t).view(np.int64) for t in blobs(b.column("text"))]
                yield pa.record_batch([b.column("node"), b.column("copies"), pa.array(sets, pa.list_(pa.int64()))], ["node", "copies", "shingles"])

    return stored(texts.select("node", "copies", "text").mapInArrow(run, "node long, copies long, shingles array<long>"), "sets")


def _unpacked(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    t = table.sort_by("node")
    return t, [np.asarray(x.values).view(U64) for x in t.column("shingles").combine_chunks()]


def chunk_keys(parts: int):
    """Chunk of classes -> all their shingles, once each, with how many of the classes have it (at most 255)."""

    def run(table: pa.Table) -> pa.Table:
        keys, times = np.unique(np.concatenate(_unpacked(table)[1]), return_counts=True)
        chunk, times = table.column("chunk")[0].as_py(), np.minimum(times, 255).astype(np.uint8)
        rows = [{"chunk": chunk, "part": p, "keys": binary(keys[at]), "times": binary(times[at])} for p, at in _by_part(_part(keys, parts))]
        return pa.Table.from_pylist(rows, _schema("chunk int, part int, keys binary, times binary"))

    return run


def total_times(table: pa.Table) -> pa.Table:
    """Key range -> for each chunk's keys, how many classes have it (at most 255)."""
    keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("times").to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(place, times), 255).astype(np.uint8)[place]
    said = [binary(x) for x in np.split(total, np.cumsum([len(x) for x in keys])[:-1])]
    return pa.table([table.column("chunk"), table.column("part"), pa.array(said, pa.binary())], _schema(TIMES))


LISTS = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("size", pa.int32()), ("alone", pa.int32()), ("heads", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])


def index_entries(parts: int):
    """Chunk of classes and the times of their shingles -> LISTS of those that can still have a similar one: the number
    of shingles that are their own, the first HEADS others by hash, and the others of the prefix, rarest first."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], LISTS)
        t, sets = _unpacked(table)
        keys, place = np.unique(np.concatenate(sets), return_inverse=True)
        by_part, times = dict(zip(replies.column("part").to_pylist(), replies.column("times").to_pylist())), np.zeros(len(keys), np.uint8)
        for p, at in _by_part(_part(keys, parts)):
            times[at] = np.frombuffer(by_part[p], np.uint8)
        times, at, rows = times[place], 0, []
        for node, copies, shingles in zip(t.column("node").to_pylist(), t.column("copies").to_pylist(), sets):
            n = len(shingles)
            often, at = times[at : at + n], at + n
            shared = shingles[often > 1]
            alone = n - len(shared)
            if len(shared) >= needed(n):
                prefix = shared[np.argsort(often[often > 1], kind="stable")][: n - needed(n) + 1 - alone]
                rows.append({"node": node, "copies": copies, "size": n, "alone": alone, "heads": shared[:HEADS].view(np.int64), "prefix": prefix.view(np.int64)})
        del sets, keys, place, times
        trim()
        return pa.Table.from_pylist(rows, LISTS)

    return run


def listed(sets: DataFrame) -> DataFrame:
    """LISTS of the classes of `sets`, every shingle counted among them, stored."""
    parts = ranges(sets, F.size("shingles"))
    rows = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")).repartition(parts, "chunk")
    keys = rows.groupBy("chunk").applyInArrow(chunk_keys(parts), "chunk int, part int, keys binary, times binary")
    times = keys.groupBy("part").applyInArrow(total_times, TIMES)
    found = rows.groupBy("chunk").cogroup(times.groupBy("chunk")).applyInArrow(index_entries(parts), "node long, copies long, size int, alone int, heads array<long>, prefix array<long>")
    return stored(found, "lists")


def followers(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """node, copies, leader, length, cost, items of every class in a group, the leader's own row included, stored."""
    # in each list the class with the fewest shingles of its own leads: it is the likeliest to be what others were made of
    heads = lists.select("node", F.struct("alone", F.xxhash64("node").alias("h"), "node").alias("rank"), F.explode("heads").alias("key"))
    leads = heads.groupBy("key").agg(F.min("rank").alias("lead"))
    asked = heads.join(leads, "key").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    choice = stored(asked.groupBy("node").agg(F.min(F.struct(-F.col("n"), "lead")).alias("best")).select("node", F.col("best.lead.node").alias("leader")), "choice")
    # who chose a follower goes on to that one's leader
    further = choice.select(F.col("node").alias("leader"), F.col("leader").alias("further"))
    roots = choice.filter("node = leader").select(F.col("node").alias("leader"))
    chosen = choice.join(further, "leader").select("node", F.col("further").alias("leader")).filter("node <> leader").join(roots, "leader", "left_semi")
    own = sets.select("node", "copies", F.col("shingles").alias("own"))
    led = chosen.join(own, "node").join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("lead")), "leader")
    apart = led.select("node", "copies", "leader", F.size("lead").alias("length"), F.size("own").alias("size"), F.array_except("lead", "own").alias("lacks"), F.array_except("own", "lead").alias("besides"))
    cost = (5 * F.size("lacks") + 4 * F.size("besides")).alias("cost")
    members = apart.filter(100 * (F.col("length") - F.size("lacks")) >= FOLLOWS * (F.col("length") + F.size("besides"))).select("node", "copies", "leader", "length", cost, F.concat("lacks", "besides").alias("items"))
    members = stored(members, "members")
    heads_of = members.select(F.col("leader").alias("node"), "length").distinct().join(lists.select("node", "copies"), "node")
    itself = heads_of.select("node", "copies", F.col("node").alias("leader"), "length", F.lit(0).alias("cost"), F.array().cast("array<bigint>").alias("items"))
    return stored(members.unionByName(itself), "groups")


def certain_links(groups: DataFrame) -> DataFrame:
    """node, n: the copies of other classes of its group that cost(x) + cost(y) <= length links to it.

    Sums run over a group's distinct costs, of which no more than the leader's length matter, not over its members."""
    costs = groups.filter("cost <= length").groupBy("leader", "length", "cost").agg(F.sum("copies").alias("w"))
    points = costs.select("leader", F.col("cost").alias("at"), F.lit(0).alias("ask"), "w", F.lit(None).cast("int").alias("cost"))
    asks = costs.select("leader", (F.col("length") - F.col("cost")).alias("at"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("w"), "cost")
    so_far = F.sum("w").over(Window.partitionBy("leader").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0))
    sums = points.unionByName(asks).withColumn("sum", so_far).filter("ask = 1").select("leader", "cost", "sum")
    own = F.when(2 * F.col("cost") <= F.col("length"), F.col("copies")).otherwise(0)
    return groups.join(sums, ["leader", "cost"]).select("node", (F.col("sum") - own).alias("n"))


def list_pairs(entries: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Distinct pairs (a, b) of nodes in a common list that `condition` (on x.* and y.*) allows.

    entries: `keys`, node, band, lo, hi and what the condition reads. x meets the y of its list whose band is from x's lo
    to its hi; other blocks of the list are skipped. A block of over SPLIT rows is split by y into several tasks."""
    entries = stored(entries, "entries")
    blocks = entries.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).withColumn("salts", F.ceil(F.col("n") / SPLIT).cast("int")).drop("n")
    x = entries.filter("lo <= hi").withColumn("band_of", F.explode(F.sequence("lo", "hi")))
    y = entries
    by = [*keys, "band_of"]
    if blocks.limit(1).count():
        blocks = stored(blocks, "blocks").withColumnRenamed("band", "band_of")
        x = x.join(blocks, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        y = y.withColumn("band_of", F.col("band")).join(blocks, by, "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int"))
        by = [*by, "salt"]
    else:
        y = y.withColumn("band_of", F.col("band"))
    same = reduce(lambda c, k: c & (F.col(f"x.{k}") == F.col(f"y.{k}")), by, F.lit(True))
    met = x.alias("x").join(y.alias("y"), same & condition)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def group_links(groups: DataFrame) -> DataFrame:
    """Links (a, b) of followers of one leader with cost(a) + cost(b) > length: they share differences."""
    highest = stored(groups.groupBy("leader").agg(F.max("cost").alias("highest")), "highest")
    open_ = groups.join(F.broadcast(highest) if highest.count() <= BROADCAST else highest, "leader").filter("cost + highest > length and cost > 0").drop("highest", "copies")
    items = open_.select("leader", "node", "length", "cost", F.explode("items").alias("item"))
    times = items.groupBy("leader", "item").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    ranked = items.join(times, ["leader", "item"]).groupBy("leader", "node", "length", "cost").agg(F.array_sort(F.collect_list(F.struct("times", "item"))).alias("ranked"))
    # a partner shares at least one difference, and (cost - length) / 5 of them, as its own cost is 4 a difference at least
    least = F.greatest(F.lit(1), F.expr("(cost - length + 4) div 5")).cast("int")
    ranked = stored(ranked.withColumn("least", least).filter("size(ranked) >= least"), "ranked")
    rest, width = F.size("ranked") - F.col("at"), F.greatest(F.expr("length div 8"), F.lit(1))
    entries = ranked.select("*", F.posexplode(F.expr("slice(ranked, 1, size(ranked) - least + 1)")).alias("at", "e")).select("leader", F.col("e.item").alias("item"), "node", "length", "cost", rest.alias("rest"), width.alias("width"))
    band = lambda c: F.floor(c / F.col("width")).cast("int")
    low, high = F.greatest(F.col("length") - F.col("cost") + 1, F.lit(0)), F.least(F.col("cost"), F.col("length") - F.col("cost") + 9 * F.col("rest"))
    entries = entries.select("leader", "item", "node", "length", "cost", "rest", band(F.col("cost")).alias("band"), band(low).alias("lo"), band(high).alias("hi"))
    lower = F.struct("y.cost", "y.node") < F.struct("x.cost", "x.node")
    over = F.col("x.cost") + F.col("y.cost") - F.col("x.length")
    pairs = list_pairs(entries, ["leader", "item"], lower & (over > 0) & (9 * F.least("x.rest", "y.rest") >= over))
    own = lambda c: ranked.select(F.col("node").alias(c), "length", F.col("cost").alias(f"{c}_cost"), F.col("ranked.item").alias(f"{c}_items"))
    both = pairs.join(own("a"), "a").join(own("b").drop("length"), "b")
    return both.filter(F.col("a_cost") + F.col("b_cost") <= F.col("length") + 9 * F.size(F.array_intersect("a_items", "b_items"))).select("a", "b")


def similar(overlap: Column, a: Column, b: Column) -> Column:
    return 180 * overlap >= 80 * (a + b)


def cross_links(lists: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of classes that follow different leaders, or none."""
    of = lists.join(groups.select("node", "leader"), "node", "left").withColumn("leader", F.coalesce("leader", "node"))
    entries = of.select("node", "leader", "size", "alone", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at") + F.col("alone"))
    mixed = entries.groupBy("key").agg(F.min("leader").alias("low"), F.max("leader").alias("high")).filter("low <> high").select("key")
    band = lambda c: F.floor(F.log(c) / float(np.log(1.25))).cast("int")
    # x meets y of its size at most; from its place on it has size - at shingles, which bounds the size of y
    most = F.least(F.col("size"), F.expr("(100 * size - 180 * at) div 80"))
    hi = F.when(most >= F.expr("(4 * size + 4) div 5"), band(F.greatest(most, F.lit(1)))).otherwise(-1)
    entries = entries.join(mixed, "key", "left_semi").select("key", "node", "leader", "size", "at", band(F.col("size")).alias("band"), band(F.expr("(4 * size + 4) div 5")).alias("lo"), hi.alias("hi"))
    lower = F.struct("y.size", "y.node") < F.struct("x.size", "x.node")
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    pairs = list_pairs(entries, ["key"], (F.col("x.leader") != F.col("y.leader")) & lower & similar(left, F.col("x.size"), F.col("y.size")))
    own = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    return both.filter(similar(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"))).select("a", "b")


def linked_classes(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """node, label (the least node of its component), links: how many documents outside its class each class links to."""
    groups = followers(lists, sets)
    links = stored(group_links(groups).unionByName(cross_links(lists, groups, sets)), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = both.join(lists.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n")).unionByName(certain_links(groups))
    counted = weights.groupBy("node").agg(F.sum("n").alias("links"))
    # whoever links to its leader has its label; components join what is left
    first = stored(lists.select("node").join(groups.filter("cost <= length").select("node", "leader"), "node", "left").withColumn("first", F.coalesce("leader", "node")).drop("leader"), "first")
    of = lambda c: first.select(F.col("node").alias(c), F.col("first").alias(f"{c}_first"))
    edges = links.join(of("a"), "a").join(of("b"), "b").filter("a_first <> b_first").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")).distinct()
    further = components(edges).select(F.col("node").alias("first"), "label")
    return first.join(further, "first", "left").join(counted, "node", "left").select("node", F.coalesce("label", "first").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))


def groups_of(rows: DataFrame) -> DataFrame:
    """Of rows that `identified` stored: row_id, doc_id, n_shingles, component_id, class_id, n_links and component.

    component_id and class_id are the least doc_id of the component and of the equal sets; component numbers components,
    whatever the ids. n_links counts the other documents that the document links to."""
    one = rows.select("row_id", F.col("doc.doc_id").cast("long").alias("doc_id"), "one", "two", "size", (F.octet_length("low") / 8).cast("int").alias("n_low"))
    equal = one.filter("size > 0").groupBy("one", "two", "size").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("n_low").alias("n_low"))
    classes = stored(equal, "classes")
    sets = candidate_sets(rows, classes)
    found = classes.join(linked_classes(listed(sets), sets), "node", "left").withColumn("component", F.coalesce("label", "node"))
    least = found.groupBy("component").agg(F.min("class_id").alias("component_id"))
    found = found.join(least, "component").select("one", "two", "size", "component", "component_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = one.join(found, ["one", "two", "size"], "left")
    alone = F.col("size") == 0
    return full.select(
        "row_id", "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row_id").alias("component"),
    )


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every document."""
    return groups_of(identified(docs.select("doc_id", "text"))).drop("row_id", "component")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each component: the one with the least doc_id, of equal ids the first row; null comes last."""
    rows = identified(docs)
    found = stored(groups_of(rows).select("row_id", "doc_id", "component"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    kept = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min_by("row_id", order).alias("kept")).filter("n > 1")
    gone = stored(found.join(kept, "component").filter("row_id <> kept").select("row_id"), "copies")
    side = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    return rows.select("row_id", "doc").join(side, "row_id", "left_anti").select("doc.*")
