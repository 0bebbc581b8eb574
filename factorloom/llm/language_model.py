"""Language-model scores of whole documents: global token counts and a gated recurrent model over them.

Token counts, the number of tokens N and of distinct tokens V cover every training document. The most frequent words,
as many as grow with the root of V, get weights of their own; every other word belongs to one of 32 tail classes by its
first two bytes, within which its probability is its add-one share of the class's counts, one place being kept for all
unseen words. So the model is a distribution over the whole vocabulary, and every count in the corpus bears on it.

The recurrent weights learn from every token of every training text, several times from those of a corpus of few
(FLOOR). A text belongs to one of ROUNDS rounds and to a shard, by a hash of doc_id and text. In a round every shard
starts from the same weights, fits them to its texts by truncated backpropagation in its own task, and the shards'
weights are averaged, by shares of tokens. Shards, and tokens of a shard, grow with the root of the corpus.

Words carry 64-bit names whose low bits are the tail class. Texts are cut into tokens once, where they are read, and
stored by chunk as numbers of the chunk's distinct words; names go from chunks to their key range, are counted there,
and the counts come back. Training and scoring move numbers, never text.

Defined cases: a null or empty text is its end token alone. Rows that repeat are counted and scored each for itself.
Without training rows N and V are 0 and the score is the base score, 0. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import LOWER, U64, binary, blobs, mix, small_batches, stored, word_lists
from factorloom.llm.gru import TAILS, Gru, train
from factorloom.llm.language_id import held_out
from factorloom.llm.substring_dedup import _by_part, _schema

#: Documents and bytes of text of a chunk at most; a single text may be longer.
CHUNK, CHUNK_BYTES = 3000, 16 << 20
#: Training tokens below which each is learned up to four times; rounds; tokens of a round's shard in a corpus of one
#: shard, beyond which shards grow with the root of the corpus.
FLOOR, ROUNDS, SHARD = 700_000, 4, 200_000
#: Distinct words of a key range, summed over chunks, that are meant to meet in a task.
RANGE = 400_000
TOKENS = "chunk long, doc_ids array<long>, learn binary, names binary, lengths binary, low binary, high binary, keys binary, counts binary, distinct long"
ASKED = "chunk long, part int, keys binary, counts binary"
LEXICON = "part int, chunk long, keys binary, counts binary, n long, v long, tail_n array<long>, tail_v array<long>, often array<long>"


class Ids(dict):
    """Numbers of words, 0 for the end token; a word that is new gets the next one."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def ids_of(text: bytes, ids: Ids) -> np.ndarray:
    """Numbers of a text's words, new ones added to ids, and 0 for its end."""
    return np.concatenate([*(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in word_lists(text.translate(LOWER))), np.zeros(1, np.int32)])


def key_of(word: bytes) -> int:
    """A word's 64-bit name; its low bits are the tail class. The end token is the empty word."""
    return (xxhash.xxh3_64_intdigest(word) & ~(TAILS - 1)) | ((word[0] * 7 + (word[1] if len(word) > 1 else 0) * 31) % TAILS if word else 0)


END = key_of(b"")


def keys_of(words: list[bytes] | dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(key_of, words), U64, len(words))


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Key ranges, which ascend with the keys."""
    return (((keys >> U64(33)) * U64(parts)) >> U64(31)).astype(np.int32)


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, learn, name) -> chunks of documents as numbers of the chunk's distinct words, with these
    words' keys, which ascend, and their counts in training documents."""
    kinds = pa.schema([(k, pa.list_(pa.int64()) if "array" in t else pa.int64() if t == "long" else pa.binary()) for k, t in (x.split() for x in TOKENS.split(", "))])
    place, made = TaskContext.get().partitionId() << 32, 0
    ids, texts, rows, size = Ids(), [], [], 0

    def sent() -> pa.RecordBatch:
        keys, learn, lengths = keys_of(ids), np.array([r[1] for r in rows]), np.array([len(x) for x in texts], np.int64)
        order = np.argsort(keys, kind="stable")
        number = np.empty(len(keys), np.int32)
        number[order] = np.arange(len(keys), dtype=np.int32)
        flat = number[np.concatenate(texts)]
        counts = np.bincount(flat[np.repeat(learn, lengths)], minlength=len(keys)).astype(np.uint32)
        names = np.array([r[2] for r in rows], np.int64)
        row = [place + made, [r[0] for r in rows], binary(learn), binary(names), binary(lengths), binary(flat.astype(np.uint16)), binary((flat >> 16).astype(np.uint16)), binary(keys[order]), binary(counts), len(keys)]
        return pa.record_batch([pa.array([x], k.type) for x, k in zip(row, kinds)], kinds)

    for b in batches:
        for doc_id, text, learn, name in zip(b.column("doc_id").to_pylist(), blobs(b.column("text")), b.column("learn").to_pylist(), b.column("name").to_pylist()):
            texts.append(ids_of(text, ids))
            rows.append((doc_id, learn, name))
            size += len(text)
            if len(rows) >= CHUNK or size >= CHUNK_BYTES:
                yield sent()
                ids, texts, rows, size, made = Ids(), [], [], 0, made + 1
    if rows:
        yield sent()


class Chunk:
    """A chunk of documents: `flat` are the numbers of all their words, one document after the other."""

    def __init__(self, row: dict):
        self.learn, self.names, self.lengths = np.frombuffer(row["learn"], bool), np.frombuffer(row["names"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.flat = np.frombuffer(row["high"], np.uint16).astype(np.int32)
        self.flat <<= 16
        self.flat |= np.frombuffer(row["low"], np.uint16)


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def asked(parts: int):
    """Chunk -> its distinct words and their counts, by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in one_by_one(b):
                keys, counts = np.frombuffer(r["keys"], U64), np.frombuffer(r["counts"], np.uint32)
                rows = [{"chunk": r["chunk"], "part": p, "keys": binary(keys[at]), "counts": binary(counts[at])} for p, at in _by_part(range_of(keys, parts))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


#: Sizes of counts, eight to an octave.
SIZES = 8 * 64


def size_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def summed(table: pa.Table) -> pa.Table:
    """Key range -> its words' total counts, with sums by tail class and how many words there are of each size of count;
    and a row for each chunk: the totals of its words, in their order there. Words of no training document have none."""
    parts = [np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, counts, len(keys)).astype(np.int64)
    replies = np.split(total[place], np.cumsum([len(x) for x in parts])[:-1])
    keys, total = keys[total > 0], total[total > 0]
    tail = (keys & U64(TAILS - 1)).astype(np.int64)
    part = table.column("part")[0].as_py()
    row = {
        "part": part, "chunk": None, "keys": binary(keys), "counts": binary(total), "n": int(total.sum()), "v": len(keys),
        "tail_n": np.bincount(tail, total, TAILS).astype(np.int64).tolist(), "tail_v": np.bincount(tail, minlength=TAILS).tolist(),
        "often": np.bincount(size_of(total), minlength=SIZES).tolist(),
    }
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    told = [{"part": part, "chunk": c, "counts": binary(x)} for c, x in zip(table.column("chunk").to_pylist(), replies)]
    return pa.Table.from_pylist([row, *told], pa.schema(list(zip(row, kinds))))


class Vocabulary:
    """The head words' keys, by frequency, and what the tail classes hold besides them."""

    def __init__(self, top: list[tuple[int, int]], n: int, v: int, tail_n: list[int], tail_v: list[int]):
        self.n, self.v = n, v
        self.head = np.array([k for k, _ in top], np.int64).view(U64)
        self.counts = np.array([c for _, c in top], np.int64)
        of = (self.head & U64(TAILS - 1)).astype(np.int64)
        self.tail_n = np.array(tail_n, np.int64) - np.bincount(of, self.counts, TAILS).astype(np.int64)
        self.tail_v = np.array(tail_v, np.int64) - np.bincount(of, minlength=TAILS)
        self.order = np.argsort(self.head)
        self.end = int(np.flatnonzero(self.head == U64(END))[0])

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Model ids of word keys: a head word's place, or its tail class after the head."""
        at = np.minimum(np.searchsorted(self.head[self.order], keys), len(self.head) - 1)
        found = self.order[at]
        return np.where(self.head[found] == keys, found, len(self.head) + (keys & U64(TAILS - 1)).astype(np.int64)).astype(np.int32)


def class_width(v: int) -> int:
    """Words in a class, and classes of words, of v distinct ones: words with weights of their own grow with the root of v."""
    return max(32, int(np.ceil(1.5 * v**0.25)))


def most_frequent(lexicon: DataFrame, least: int) -> list[tuple[int, int]]:
    """(key, count) of the words whose count has size `least` or more, and of the end token."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys, counts = np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)
                at = np.flatnonzero((size_of(counts) >= least) | (keys == U64(END)))
                yield pa.record_batch([pa.array(keys[at].view(np.int64)), pa.array(counts[at])], ["key", "n"])

    return [(r.key, r.n) for r in lexicon.select("keys", "counts").mapInArrow(top, "key long, n long").collect()]


def vocabulary_of(lexicon: DataFrame) -> Vocabulary | None:
    """None of an empty lexicon. Head words are those of a size of count and above, the square of class_width at most."""
    sums = lexicon.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("tail_n", "tail_v") for k in range(TAILS)]).first()
    if not sums.n:
        return None
    sizes = lexicon.select(F.posexplode("often").alias("size", "words")).groupBy("size").agg(F.sum("words").alias("words")).collect()
    words = np.zeros(SIZES + 1, np.int64)
    words[[r["size"] for r in sizes]] = [r.words for r in sizes]
    above = np.cumsum(words[::-1])[::-1]  # words of this size or more
    least = int(np.flatnonzero(above < class_width(sums.v) ** 2)[0])
    top = sorted(most_frequent(lexicon, least), key=lambda x: (-x[1], x[0]))
    return Vocabulary(top, sums.n, sums.v, [sums[f"tail_n{k}"] for k in range(TAILS)], [sums[f"tail_v{k}"] for k in range(TAILS)])


def number_type(words: Vocabulary) -> type:
    """What holds model ids."""
    return np.uint16 if len(words.head) + TAILS < 1 << 16 else np.int32


DEALT = "shard int, names binary, lengths binary, ids binary"


def dealt(words, turn: int, shards: int):
    """Chunk -> its training documents of a round as model ids, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = number_type(words.value)
        for b in batches:
            for r in one_by_one(b):
                c = Chunk(r)
                known = words.value.ids(np.frombuffer(r["keys"], U64)).astype(kind)
                first, name = np.cumsum(c.lengths) - c.lengths, c.names.view(U64)
                of = (mix(name, U64(29)) >> U64(33)) % U64(ROUNDS)
                at = np.flatnonzero(c.learn & (of == turn))
                shard = ((mix(name[at], U64(31)) >> U64(33)) % U64(shards)).astype(np.int32)
                rows = []
                for s, k in _by_part(shard):
                    own = at[k]
                    ids = known[np.concatenate([c.flat[first[i] : first[i] + c.lengths[i]] for i in own])]
                    rows.append({"shard": s, "names": binary(c.names[own]), "lengths": binary(c.lengths[own]), "ids": binary(ids)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), *[(x, pa.binary()) for x in ("names", "lengths", "ids")]]))

    return run


def shard_fits(words, model, turn: int, tokens: int, passes: int):
    """Rows of dealt, sorted by shard -> shard, weights, tokens: the model fitted to each shard's texts, by their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in one_by_one(b))
        for shard, of in groupby(rows, key=lambda r: r["shard"]):
            of = list(of)
            names, lengths = (np.concatenate([np.frombuffer(r[c], np.int64) for r in of]) for c in ("names", "lengths"))
            ids = np.concatenate([np.frombuffer(r["ids"], number_type(words.value)) for r in of])
            del of
            ends = np.cumsum(lengths)
            texts = [ids[ends[i] - lengths[i] : ends[i]] for i in np.argsort(names, kind="stable")]
            fit = model.value.unpacked(model.value.packed())
            n = train(fit, texts * passes, words.value.end, turn, tokens, ROUNDS)
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([fit.packed()], pa.binary()), pa.array([n], pa.int64())], ["shard", "weights", "tokens"])

    return run


def averaged(table: pa.Table) -> pa.Table:
    """Weights of some shards -> their average by tokens."""
    t = table.sort_by("shard")
    tokens = t.column("tokens").to_numpy()
    total, mean = max(int(tokens.sum()), 1), 0.0
    for x, n in zip(t.column("weights"), tokens):
        mean = mean + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * (n / total)
    return pa.table([pa.array([t.column("slot")[0].as_py()], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([int(tokens.sum())], pa.int64())], ["slot", "weights", "tokens"])


def fitted(chunks: DataFrame, words: Vocabulary) -> tuple[Gru, int]:
    """The model after ROUNDS rounds over all training texts, and the tokens it learned; what reaches the driver are 16
    averages a round."""
    spark = chunks.sparkSession
    model, learned = Gru.new(len(words.head), class_width(words.v)), 0
    model.start_biases(np.concatenate((words.counts, words.tail_n)))
    shards = max(1, round(float(np.sqrt(words.n / ROUNDS / SHARD))))
    passes = max(1, min(4, round(FLOOR / words.n)))
    sent = spark.sparkContext.broadcast(words)
    tokens = words.n * passes // ROUNDS // shards
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        texts = chunks.select("learn", "names", "lengths", "low", "high", "keys").mapInArrow(dealt(sent, k, shards), DEALT)
        fits = texts.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(shard_fits(sent, now, k, tokens, passes), "shard int, weights binary, tokens long")
        slots = fits.withColumn("slot", F.pmod("shard", F.lit(16)).cast("int")).groupBy("slot").applyInArrow(averaged, "slot int, weights binary, tokens long").toArrow()
        if slots.num_rows:
            mean = averaged(slots.rename_columns(["shard", "weights", "tokens"]).append_column("slot", pa.array([0] * slots.num_rows, pa.int32())))
            model = model.unpacked(mean.column("weights")[0].as_py())
            learned += mean.column("tokens")[0].as_py()
        now.unpersist()
    if learned != words.n * passes:
        raise RuntimeError(f"the model learned {learned} tokens of {words.n * passes}")
    return model, learned


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED = pa.schema([(x.split()[0], pa.float64() if "double" in x else pa.int64()) for x in RESULT.split(", ")])


def scored(sent):
    """Chunk and its words' counts -> scores."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], SCORED)
        words, model = sent.value
        row = table.to_pylist()[0]
        c = Chunk(row)
        # words and key ranges ascend by key
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in replies.sort_by("part").column("counts").to_pylist()])
        n, v = (words.n, words.v) if words else (0, 0)
        base = np.log10((counts + 1) / (n + v + 1))
        first = np.cumsum(c.lengths) - c.lengths
        out = {
            "doc_id": row["doc_ids"], "n_tokens": c.lengths, "n_known": np.add.reduceat((counts > 0)[c.flat].astype(np.int64), first), "train_tokens": np.full(len(first), n),
            "base_score": np.add.reduceat(base[c.flat], first),
        }
        if words is None:
            return pa.table(out | {"score": out["base_score"]}, SCORED)
        ids, cls = np.frombuffer(row["ids"], number_type(words)), np.frombuffer(row["tails"], np.uint8)
        inner = np.where(ids < len(words.head), 0.0, np.log((counts + 1) / (words.tail_n + words.tail_v + 1)[cls]))
        ids, ends = ids[c.flat].astype(np.int32), (first + c.lengths).tolist()
        inner = np.add.reduceat(inner[c.flat], first)
        found = model.score([ids[i:j] for i, j in zip(first.tolist(), ends)], words.end, [inner[k : k + 1] for k in range(len(first))]) / np.log(10)
        return pa.table(out | {"score": found}, SCORED)

    return run


NAMED = "chunk long, doc_ids array<long>, learn binary, names binary, lengths binary, low binary, high binary, ids binary, tails binary"


def named(sent):
    """Chunk -> the same with model ids and tail classes of its words in place of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = sent.value
        for b in batches:
            keys = [np.frombuffer(x, U64) for x in b.column("keys").to_pylist()]
            ids = [binary(words.ids(k).astype(number_type(words))) if words else b"" for k in keys]
            tails = [binary((k & U64(TAILS - 1)).astype(np.uint8)) for k in keys]
            yield b.drop_columns(["keys"]).append_column("ids", pa.array(ids, pa.binary())).append_column("tails", pa.array(tails, pa.binary()))

    return run


def chunks_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored chunks of tokens, and by key range the words' counts, followed by those of each chunk's words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", (~F.coalesce(held_out(7, 2), F.lit(False))).alias("learn"), F.xxhash64("doc_id", "text").alias("name"))
    chunks = stored(rows.mapInArrow(tokenised, TOKENS), "tokens")
    distinct = chunks.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n")).first().n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // RANGE))
    return chunks, stored(chunks.select("chunk", "keys", "counts").mapInArrow(asked(parts), ASKED).groupBy("part").applyInArrow(summed, LEXICON), "lexicon")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    chunks, counted = chunks_of(docs)
    words = vocabulary_of(counted.filter("chunk is null"))
    model = fitted(chunks, words)[0] if words else None
    sent = docs.sparkSession.sparkContext.broadcast((words, model))  # weights by the root of the vocabulary
    texts = chunks.select("chunk", "doc_ids", "learn", "names", "lengths", "low", "high", "keys").mapInArrow(named(sent), NAMED)
    replies = counted.filter("chunk is not null").select("chunk", "part", "counts")
    found = texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(scored(sent), RESULT)
    return found.withColumn("held_out", held_out(7, 2))
