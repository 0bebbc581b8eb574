"""Removal of word passages that repeat anywhere in the corpus, found by recompression.

Every text is a sequence of word names. Each round gives a new name to every maximal run of one symbol and to every
adjacent pair of a "left" and a "right" symbol, sides being a bit of the symbol's hash in that round. Names are hashes
of content, so all tasks give equal substrings equal symbols in their interior; only symbols near the ends of a
repeat can differ. A symbol carries the interval of words that settles it (its context). A window that repeats
shares every symbol whose context lies inside the window, so a window with a symbol that occurs only once in the
corpus can't repeat. Windows that are left, those without any such symbol among them, are verified by 128-bit names
of their whole word sequence.

Spark moves text once, by chunk, and names twice, by key range: chunk -> key range (count) -> chunk. Naming needs no
round trips: a round's names are hashes of what they stand for, so every task that applies the round gives the same
names, and the rounds' outcome, counts and verification are what moves between tasks.

Defined cases: a null, empty or short text (fewer words than a window) keeps all its words. Equal rows, with equal
doc_id or not, are separate texts and so repeats of each other. Only doc_id and text are read; other columns may have
any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm.common import U64, binary, blobs, block_hash, in_chunks, mix, part_of, word_hashes

#: Rounds after which a symbol's context is about 17 words, well inside a window of 35.
ROUNDS = 6
KEYS = "chunk int, part int, keys binary, more binary"
FLAGS = "chunk int, part int, flags binary"
WINDOWS = "chunk int, part int, keys binary, checks binary, places binary"
PLACES = "chunk int, places binary"


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    """Symbols after `rounds` rounds: name, context [low, high) and document. Contexts that need a word beyond the
    text's end reach outside the text."""
    words = names
    low = np.arange(len(names))
    high = low + 1
    start, end = low, high
    for k in range(rounds):
        if not len(names):
            break
        same = doc[1:] == doc[:-1]
        equal = same & (names[1:] == names[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~equal)))
        last = np.concatenate((first[1:], [len(names)])) - 1
        run = last > first
        # That a run, or a single symbol, ends here depends on the neighbour: on its adjacent word if that differs from
        # the word in its place, else on the neighbour's whole context.
        joined = np.concatenate(([False], same, [False]))
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(names) - 1)
        alike_left = joined[first] & (words[start[first] - 1] == words[end[first] - 1])
        alike_right = joined[last + 1] & (words[np.minimum(end[last], len(words) - 1)] == words[start[last]])
        left = np.where(alike_left, low[before], start[first] - 1)
        right = np.where(alike_right, high[after], end[last] + 1)
        named = names[first]
        named[run] = mix(named[run], (last - first + 1)[run].astype(U64))
        low, high = np.minimum(left, low[first]), np.maximum(right, high[last])
        names, start, end, doc = named, start[first], end[last], doc[first]
        same = doc[1:] == doc[:-1]
        side = ((mix(names, U64(k + 1)) >> U64(17)) & U64(1)).astype(bool)
        opens = np.concatenate((same & side[:-1] & ~side[1:], [False]))
        closes = np.concatenate(([False], opens[:-1]))
        left = np.where(np.concatenate(([False], same)), np.concatenate(([0], low[:-1])), start - 1)
        right = np.where(np.concatenate((same, [False])), np.concatenate((high[1:], [0])), end + 1)
        alone_low, alone_high = np.where(side, low, np.minimum(low, left)), np.where(side, np.maximum(high, right), high)
        i = np.flatnonzero(~closes)
        j, p = np.minimum(i + 1, len(names) - 1), opens[i]
        low, high = np.where(p, np.minimum(low[i], low[j]), alone_low[i]), np.where(p, np.maximum(high[i], high[j]), alone_high[i])
        start, end = start[i], np.where(p, end[j], end[i])
        names, doc = np.where(p, mix(names[i], names[j]), names[i]), doc[i]
    return {"name": names, "low": low, "high": high, "doc": doc}


class Words:
    """The words of a chunk's documents, in order of row_id, as names, with each document's range."""

    def __init__(self, table: pa.Table, named: bool = True):
        self.table = table.sort_by("row_id")
        self.words = [x.split() for x in blobs(self.table.column("text"))]
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.total = int(self.lengths.sum())
        if named:
            self.names = word_hashes([w for x in self.words for w in x])

    def symbols(self, window: int) -> dict[str, np.ndarray]:
        """Symbols whose context lies in the text and within a window, with keys that name the symbol and context size."""
        x = recompress(self.names, np.repeat(np.arange(len(self.words)), self.lengths), ROUNDS)
        doc = x["doc"]
        ok = (x["high"] - x["low"] <= window) & (x["low"] >= self.first[doc]) & (x["high"] <= (self.first + self.lengths)[doc])
        x = {k: v[ok] for k, v in x.items()}
        return x | {"key": mix(x["name"], (x["high"] - x["low"]).astype(U64))}


def _sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(part[at[0]]), at


def symbol_keys(window: int, parts: int):
    """Chunk -> its distinct symbol keys by key range; more: whether the chunk has the key twice."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        keys, counts = _sorted_keys(Words(table).symbols(window)["key"])
        rows = [{"chunk": chunk, "part": p, "keys": binary(keys[at]), "more": binary(counts[at] > 1)} for p, at in _by_part(part_of(keys, parts))]
        return pa.Table.from_pylist(rows, _schema(KEYS))

    return run


def shared_keys(table: pa.Table) -> pa.Table:
    """Key range -> for each chunk, whether each of its keys occurs twice or more in the corpus."""
    keys = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    more = np.concatenate([np.frombuffer(x, bool) for x in table.column("more").to_pylist()])
    _, place, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    repeated = counts > 1
    repeated[place[more]] = True
    flags = np.split(repeated[place], np.cumsum([len(x) for x in keys])[:-1])
    return pa.table([table.column("chunk"), table.column("part"), pa.array([binary(np.packbits(x)) for x in flags], pa.binary())], _schema(FLAGS))


def open_windows(window: int, parts: int):
    """Chunk and its flags -> 128-bit names of the windows all of whose symbols are repeated.

    A window name that the chunk has twice settles its places here (part -1); its name still goes out once, with
    place -1, for other chunks.
    """

    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _schema(WINDOWS))
        chunk = table.column("chunk")[0].as_py()
        w = Words(table)
        x = w.symbols(window)
        keys, place = np.unique(x["key"], return_inverse=True)
        part, repeated = part_of(keys, parts), np.zeros(len(keys), bool)
        replies = dict(zip(flags.column("part").to_pylist(), flags.column("flags").to_pylist()))
        for p, at in _by_part(part):
            repeated[at] = np.unpackbits(np.frombuffer(replies[p], np.uint8))[: len(at)].astype(bool)
        once = ~repeated[place]
        barred = np.zeros(w.total + 1, np.int32)
        low = np.maximum(x["high"][once] - window, w.first[x["doc"][once]])
        np.add.at(barred, low, 1)
        np.add.at(barred, x["low"][once] + 1, -1)
        ends = np.repeat(w.first + w.lengths, w.lengths)
        starts = np.flatnonzero((np.cumsum(barred)[: w.total] == 0) & (np.arange(w.total) + window <= ends))
        one, two = block_hash(w.names, starts, window), block_hash(w.names ^ U64(0x5851F42D4C957F2D), starts, window)
        order = np.lexsort((two, one))
        one, two, starts = one[order], two[order], starts[order].astype(np.int32)
        head = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))) if len(one) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate((head, [len(one)])))
        known = np.repeat(sizes > 1, sizes)
        rows = [{"chunk": chunk, "part": -1 - chunk, "keys": b"", "checks": b"", "places": binary(starts[known])}] if known.any() else []
        one, two, at_word = one[head], two[head], np.where(sizes > 1, -1, starts[head]).astype(np.int32)
        for p, at in _by_part(part_of(one, parts)):
            rows.append({"chunk": chunk, "part": p, "keys": binary(one[at]), "checks": binary(two[at]), "places": binary(at_word[at])})
        return pa.Table.from_pylist(rows, _schema(WINDOWS))

    return run


def repeated_places(table: pa.Table) -> pa.Table:
    """Key range -> for each chunk, the word places where windows that occur elsewhere start."""
    if table.column("part")[0].as_py() < 0:
        return table.select(["chunk", "places"])
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    places = get("places", np.int32)
    row = np.repeat(np.arange(len(places)), [len(x) for x in places])
    one, two, place = np.concatenate(get("keys", U64)), np.concatenate(get("checks", U64)), np.concatenate(places)
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    twice &= place >= 0
    out = [(k, binary(place[twice & (row == k)])) for k in np.unique(row[twice])] if len(places) < 64 else [(k, binary(place[twice][at])) for k, at in _by_part(row[twice])]
    chunks = table.column("chunk").to_pylist()
    return pa.table([pa.array([chunks[k] for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], _schema(PLACES))


def kept_words(window: int, text: bool):
    """Chunk and its repeated places -> a row per document."""

    def run(table: pa.Table, places: pa.Table) -> pa.Table:
        w = Words(table, named=False) if table.num_rows else None
        if w is None:
            return pa.Table.from_pylist([], _schema(RESULT + TEXT * text))
        cover = np.zeros(w.total + window + 1, np.int32)
        for x in places.column("places").to_pylist():
            at = np.frombuffer(x, np.int32)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        keep = np.cumsum(cover)[: w.total] == 0
        rows = []
        for doc_id, words, first in zip(w.table.column("doc_id").to_pylist(), w.words, w.first.tolist()):
            mask = keep[first : first + len(words)]
            kept = b" ".join(words if mask.all() else [words[i] for i in np.flatnonzero(mask)])
            row = {"doc_id": doc_id, "n_words": len(words), "n_removed": int((~mask).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            rows.append(row | ({"kept_text": kept.decode()} if text else {}))
        return pa.Table.from_pylist(rows, _schema(RESULT + TEXT * text))

    return run


RESULT, TEXT = "doc_id long, n_words long, n_removed long, kept_sha256 string", ", kept_text string"
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def remove_repeats(docs: DataFrame, window: int = 35, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words (and those words as kept_text, if text is set)."""
    chunks, _, parts = in_chunks(docs)
    keys = chunks.groupBy("chunk").applyInArrow(symbol_keys(window, parts), KEYS)
    flags = keys.groupBy("part").applyInArrow(shared_keys, FLAGS)
    windows = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(open_windows(window, parts), WINDOWS)
    places = windows.groupBy("part").applyInArrow(repeated_places, PLACES)
    return chunks.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(kept_words(window, text), RESULT + TEXT * text)
