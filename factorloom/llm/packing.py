"""Packing of tokenized documents into fixed-length sequences: bounded-space online best fit.

tokenize encodes every whole text and cuts only documents longer than a sequence. pack_pieces deals pieces out in
large random shares; in each share a fixed number of bins is open at once, their free space kept in a bitset. A piece
goes to the open bin with the least sufficient space; if none has it and all bins are open, the fullest closes first.
Both work in bounded memory, and only a share's last open bins stay part filled.

Defined cases: a null or empty text has no tokens but its end token, so it is a piece of length 1. Rows that repeat
are packed each for itself. Columns other than doc_id and text are not read. An empty table packs into nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import SPACE, blobs, by_bytes, small_batches, stored, trim

PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker process remembers, some 90 MB.
REMEMBERED = 400_000
#: Bytes of text that are words at once.
STRETCH = 1 << 20
OPEN_BINS, SHARE = 512, 250_000


class Encoder:
    """Token ids of texts. The tokenizer lower-cases, drops white space and never joins across it, so each distinct word
    is encoded once; a comma or full stop that ends a word is a token of its own and is parted from it first."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    @staticmethod
    def of(path: str, remembered: int = REMEMBERED) -> Encoder:
        """This worker process's encoder, kept with its memory from task to task."""
        return ENCODERS.get((path, remembered)) or ENCODERS.setdefault((path, remembered), Encoder(path, remembered))

    @staticmethod
    def forget(path: str, remembered: int = REMEMBERED) -> None:
        """Gives that memory back: worker processes outlive the stage and go on to others."""
        ENCODERS.pop((path, remembered), None)
        trim()

    def learned(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, by word."""
        out: dict[bytes, bytes] = {}
        spelled = [w.decode() for w in words]
        plain = [k for k, w in enumerate(spelled) if w.isalpha()]
        runs = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for some, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join([spelled[k] for k in some]) for some in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):  # letters alone are one unit each, and only its last token ends a word
                held, last = ids.tobytes(), 0
                for k, cut in zip(some, (4 * cuts).tolist()):
                    out[words[k]] = held[last:cut]
                    last = cut
        rest = [k for k, w in enumerate(words) if w not in out]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([spelled[k] for k in rest], add_special_tokens=False)):
            out[words[k]] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the end token. The words of a long text are objects by
        stretches only."""
        tail = np.array([end], "<u4").tobytes()
        short = self._encode([t if len(t) <= STRETCH else b"" for t in texts])
        return [(ids if len(t) <= STRETCH else b"".join(self._encode([s])[0] for s in stretches(t))) + tail for t, ids in zip(texts, short)]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        texts = [t if b"<|" in t else t.lower() for t in texts]  # names of special tokens keep their case
        split = [STOP.sub(b" .", COMMA.sub(b" ,", t)).split() for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        with_new = [(words, ids) for words, ids in zip(split, found) if None in ids]
        if with_new:  # words met early are mostly the frequent ones, so that most texts have few new ones
            new = self.learned(list({w for words, ids in with_new for w, i in zip(words, ids) if i is None}))
            if len(self.known) < self.remembered:
                self.known.update(new)
            for words, ids in with_new:
                for at in [k for k, i in enumerate(ids) if i is None]:
                    ids[at] = new[words[at]]
        return [b"".join(ids) for ids in found]


def stretches(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """A text in stretches of about `most` bytes that end after white space, across which no token reaches."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + (most or STRETCH))
        to = end.end() if end else len(text)
        yield text[at:to]
        at = to


ENCODERS: dict[tuple[str, int], Encoder] = {}
COMMA, STOP = (re.compile(mark + rb"(?<=[a-z]" + mark + rb")(?=[ \n])") for mark in (rb",", rb"\."))


def tokenize(docs: DataFrame, tokenizer: str, most: int = 4096, end: int = 1, remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, row_id, piece, start, length and the crc32 of its ids. Unless `keep`, a task
    leaves no words behind in its worker process."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(tokenizer, remembered)
        for batch in batches:
            for b in by_bytes(batch, "text", 2 << 20):
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, row_id, ids in zip(b.column("doc_id").to_pylist(), b.column("row_id").to_pylist(), encoder.encode(blobs(b.column("text")), end)):
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        for column, value in zip(rows, (doc_id, row_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(rows, kinds)], ["doc_id", "row_id", "piece", "start", "length", "ids_crc32"])
        del encoder
        if not keep:
            Encoder.forget(tokenizer, remembered)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


class BestFit:
    """Open bins keyed by free space; bit f of `free` says that some open bin has f tokens of space."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open, self.opened, self.open, self.free = size, most_open, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        held = self.bins[space]
        bin_id = held.pop()
        if not held:
            self.free ^= 1 << space
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin and offset of a piece."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            bin_id, space = self.opened, self.size
            self.opened += 1
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(bin_id)
            self.free |= 1 << left
            self.open += 1
        return bin_id, self.size - space


def pack_pieces(pieces: DataFrame, n_pieces: int, most: int = 4096, open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    """pieces with sequence_id and offset. Lengths are 1 to `most`."""
    shares = max(1, -(-n_pieces // share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, BestFit] = {}
        for b in batches:
            ids, offsets = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for k, (s, length) in enumerate(zip(b.column("share").to_pylist(), b.column("length").to_pylist())):
                packer = packers.get(s) or packers.setdefault(s, BestFit(most, open_bins))
                bin_id, offsets[k] = packer.place(length)
                ids[k] = (s << 40) | bin_id
            names = [n for n in b.schema.names if n != "share"]
            yield pa.record_batch([b.column(n) for n in names] + [pa.array(ids), pa.array(offsets)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("row_id", "piece"), F.lit(shares)))
    # a random but repeatable order of arrival: a retried task packs alike, and lengths come well mixed
    dealt = dealt.repartition("share").sortWithinPartitions("share", F.xxhash64("piece", "row_id"), "row_id", "piece")
    return dealt.mapInArrow(run, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = 4096, end: int = 1, remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenize(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), most, end, remembered, keep), "pieces")
    packed = pack_pieces(pieces, pieces.count(), most)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
