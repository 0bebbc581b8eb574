"""Transcripts, press releases and papers to chunks.

Splitting and labels are expressions. Packing works on Arrow batches: pieces of all documents of a batch lie in one flat
array, those that wait for others form runs, found by counting what sends a run out, and a run's text is one join. Only
texts longer than a chunk are walked, from cut to cut. Chunks of one document never meet another document's, so nothing
moves. `register` makes the packers table functions of SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.operators.ordering import with_position

WAITS, WHOLE, HEAD = 0, 1, 2


def heads_of(text: str, most: int) -> tuple[list[str], str]:
    """What is cut off a text longer than `most`, and the rest: cuts are after a sentence's end in the second half of
    `most` characters, the last one, or where these end."""
    heads = []
    while len(text) > most:
        ends = [text.rfind(mark, most // 2 + 1, most) for mark in (". ", "? ", "! ")]
        size = max(ends) + 1 or most
        heads.append(text[:size])
        text = text[size:].strip()
    return heads, text


def atoms(texts: pa.Array, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(piece, kind, length, text) of what pieces are packed by: pieces that wait or are whole, and of long ones their
    heads (length as cut, text stripped) and their rest. Empty texts are gone."""
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    short = np.flatnonzero((length > 0) & (length <= most))
    piece, kind, size, text = [short], [np.where(length[short] < least, WAITS, WHOLE)], [length[short]], [texts.take(pa.array(short))]
    for k in np.flatnonzero(length > most):
        heads, rest = heads_of(texts[int(k)].as_py(), most)
        found = [(HEAD, len(h), h.strip()) for h in heads] + [(WAITS if len(rest) < least else WHOLE, len(rest), rest)] * bool(rest)
        piece.append(np.full(len(found), k))
        kind.append(np.array([x[0] for x in found]))
        size.append(np.array([x[1] for x in found], np.int64))
        text.append(pa.array([x[2] for x in found], texts.type))
    order = np.argsort(np.concatenate(piece), kind="stable")
    return np.concatenate(piece)[order], np.concatenate(kind)[order], np.concatenate(size)[order], pa.concat_arrays(text).take(pa.array(order))


def runs(waits: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, after the last, sent out by) of each run among the waiting: places among `waits`, and the place of the
    atom that sends the run out (the number of atoms, if none). out tells which atoms do."""
    sent = np.cumsum(out)
    at = np.flatnonzero(waits)
    edge = np.flatnonzero(np.diff(sent[at])) + 1
    first = np.concatenate(([0], edge)) if len(at) else np.empty(0, np.int64)
    after = np.append(edge, len(at)) if len(at) else np.empty(0, np.int64)
    return first, after, np.searchsorted(sent, sent[at[first]] + 1)


def joined_runs(texts: pa.Array, first: np.ndarray, after: np.ndarray) -> pa.Array:
    """Waiting texts joined run by run; runs follow each other without gaps."""
    offsets = np.append(first, after[-1:]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), " ") if len(first) else pa.array([], texts.type)


def pack(unit: np.ndarray, texts: pa.Array, least: int, most: int, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(unit, piece, first piece, text) of chunks of pieces, which are in order of `unit`.

    Pieces shorter than `least` wait and are joined. What waits is sent out before the next whole piece, before a head
    that it would be too long with, or at the unit's end if it has `drop` characters; its piece is the one seen last
    before that, its first piece the first that waited.
    """
    piece, kind, size, text = atoms(texts, most, least)
    n = len(piece)
    if not n:
        return unit[:0], piece, piece, texts[:0]
    of = unit[piece]
    begins = np.append(True, of[1:] != of[:-1])
    waits, out = kind == WAITS, begins | (kind == WHOLE)
    adds = np.where(waits, size + 1, 0)
    filled = np.cumsum(adds)
    emptied = np.maximum.accumulate(np.where(out, filled - adds, 0))
    last = 0
    for k in np.flatnonzero(kind == HEAD):  # of texts longer than a chunk
        held = filled[k] - max(emptied[k], last)
        if held and held - 1 + size[k] > most:
            out[k], last = True, filled[k]
    first, after, by = runs(waits, out)
    at = np.flatnonzero(waits)
    said = joined_runs(text.take(pa.array(at)), first, after)
    ended = (by == n) | (of[np.minimum(by, n - 1)] != of[at[first]])
    kept = np.flatnonzero(~ended | (pc.utf8_length(said).to_numpy(zero_copy_only=False) >= drop))
    own = np.flatnonzero(~waits)
    key = np.concatenate((2 * by[kept], 2 * own + 1))
    order = np.argsort(key, kind="stable")
    columns = [np.concatenate(c)[order] for c in ((of[at[first]][kept], of[own]), (piece[by - 1][kept], piece[own]), (piece[at[first]][kept], piece[own]))]
    return *columns, pa.concat_arrays([said.take(pa.array(kept)), text.take(pa.array(own))]).take(pa.array(order))


def pack_paragraphs(page: np.ndarray, texts: pa.Array, drop: int, least: int, most: int) -> tuple[np.ndarray, pa.Array]:
    """(page, text) of chunks of pages' paragraphs, which are in order of `page`.

    Paragraphs shorter than `drop` are gone and those shorter than `least` wait. What waits joins the next long one if
    both fit in one chunk, else goes out before it, and goes out at the page's end if it has `least` characters. Longer
    paragraphs than `most` are cut; a rest shorter than `least` is gone.
    """
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    stays = np.flatnonzero(length >= drop)
    page, texts, length = page[stays], texts.take(pa.array(stays)), length[stays]
    n = len(page)
    if not n:
        return page, texts
    waits = length < least
    first, after, by = runs(waits, ~waits | np.append(True, page[1:] != page[:-1]))
    at = np.flatnonzero(waits)
    said = joined_runs(texts.take(pa.array(at)), first, after)
    size = pc.utf8_length(said).to_numpy(zero_copy_only=False)
    of, to = page[at[first]], np.minimum(by, n - 1)
    met = (by < n) & (page[to] == of)  # a long paragraph follows
    both = met & (size + 1 + length[to] <= most)
    alone = np.flatnonzero(~both & (met | (size >= least)))
    together = np.flatnonzero(both)
    whole = np.flatnonzero(~waits & ~np.isin(np.arange(n), by[together]))
    fit, long = whole[length[whole] <= most], whole[length[whole] > most]
    pair = pc.binary_join_element_wise(said.take(pa.array(together)), texts.take(pa.array(by[together])), " ")
    pages, keys, found = [of[alone], of[together], page[fit]], [2 * by[alone], 2 * by[together] + 1, 2 * fit + 1], [said.take(pa.array(alone)), pair, texts.take(pa.array(fit))]
    for k in long:
        heads, rest = heads_of(texts[int(k)].as_py(), most)
        cuts = [h.strip() for h in heads] + [rest] * (len(rest) >= least)
        pages.append(np.full(len(cuts), page[k]))
        keys.append(np.full(len(cuts), 2 * k + 1))
        found.append(pa.array(cuts, texts.type))
    order = np.argsort(np.concatenate(keys), kind="stable")
    return np.concatenate(pages)[order], pa.concat_arrays(found).take(pa.array(order))


def places(owner: np.ndarray) -> np.ndarray:
    """0, 1, 2... within each run of equal owners."""
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    return np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of a column of lists."""
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists)


TURNS = "array<struct<section:string,role:string,content:string>>"


def turns(section: str) -> Column:
    """Array of (section, role, content) of a section text column, by speaker turn; text before the first is dropped."""
    text = F.col(section)
    speakers = F.regexp_extract_all(text, F.lit(T.SPEAKER_TURN), F.lit(1))
    contents = F.split(text, T.SPEAKER_TURN, -1)
    named = F.zip_with(speakers, F.slice(contents, 2, F.greatest(F.size(contents) - 1, F.lit(1))), lambda s, c: F.struct(T.stripped(s).alias("speaker"), T.stripped(c).alias("content")))
    whole = F.array(F.struct(F.lit("").alias("speaker"), T.stripped(text).alias("content")))
    said = F.filter(F.when(F.size(speakers) > 0, named).otherwise(whole), lambda x: x["content"] != "")
    labelled = F.transform(said, lambda x: F.struct(T.section_type(x["content"]).alias("section"), T.speaker_role(x["speaker"]).alias("role"), x["content"].alias("content")))
    return F.when(T.is_blank(text), F.array().cast(TURNS)).otherwise(labelled)


CHUNKS = "symbol string, earnings_date string, section_type string, speaker_role string, text string, position int"
PAPER_CHUNKS = "paper_title string, page_num int, text string, position int"


def made(schema: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.record_batch(columns, [x.split()[0] for x in schema.split(", ")])


def packed_turns(b: pa.RecordBatch) -> pa.RecordBatch:
    """CHUNKS of rows (symbol, earnings_date, prepared, qa), sections in order."""
    parts = [flat(b.column(c)) for c in ("prepared", "qa")]
    unit = np.concatenate([2 * rows + k for k, (rows, _) in enumerate(parts)])
    order = pa.array(np.argsort(unit, kind="stable"))
    piece = pa.concat_arrays([values for _, values in parts]).take(order)
    unit, last, first, text = pack(np.sort(unit), piece.field("content"), T.MIN_CHUNK, T.MAX_CHUNK, T.DROP_CHUNK)
    row = pa.array(unit // 2)
    return made(CHUNKS, [b.column("symbol").take(row), b.column("earnings_date").take(row), piece.field("section").take(pa.array(last)), piece.field("role").take(pa.array(first)), text, pa.array(places(unit // 2).astype(np.int32))])


def packed_releases(b: pa.RecordBatch) -> pa.RecordBatch:
    """CHUNKS of rows (symbol, earnings_date, body). Every chunk has the least length."""
    unit, _, _, text = pack(np.arange(b.num_rows), pc.fill_null(b.column("body"), ""), T.MIN_CHUNK, T.MAX_CHUNK, T.DROP_CHUNK)
    kept = pa.array(np.flatnonzero(pc.utf8_length(text).to_numpy(zero_copy_only=False) >= T.DROP_CHUNK))
    row = pa.array(unit).take(kept)
    said = lambda x: pa.array([x] * len(row), pa.string())
    return made(CHUNKS, [b.column("symbol").take(row), b.column("earnings_date").take(row), said("press_release"), said("-"), text.take(kept), pa.array(places(row.to_numpy()).astype(np.int32))])


def packed_pages(b: pa.RecordBatch) -> pa.RecordBatch:
    """PAPER_CHUNKS of rows (paper_title, page_num, paragraphs)."""
    page, text = pack_paragraphs(*flat(b.column("paragraphs")), T.PAPER_DROP, T.PAPER_MIN, T.PAPER_MAX)
    row = pa.array(page)
    return made(PAPER_CHUNKS, [b.column("paper_title").take(row), b.column("page_num").take(row), text, pa.array(places(page).astype(np.int32))])


def by_batch(rows: DataFrame, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, batches)

    return rows.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    """Table functions of SQL: pack_turns, pack_releases and pack_pages over TABLE(...) arguments of the same columns."""
    for name, f, schema in (("pack_turns", packed_turns, CHUNKS), ("pack_releases", packed_releases, CHUNKS), ("pack_pages", packed_pages, PAPER_CHUNKS)):

        class Packer:
            def eval(self, batch: pa.RecordBatch, f=f) -> Iterator[pa.Table]:
                yield pa.Table.from_batches([f(batch)])

        spark.udtf.register(name, F.arrow_udtf(Packer, returnType=schema))


def transcript_parts(calls: DataFrame) -> DataFrame:
    """symbol, earnings_date, prepared, qa: the turns of transcripts (symbol, earnings_date, transcript)."""
    parts = calls.select(F.col("symbol").cast("string").alias("symbol"), F.col("earnings_date").cast("string").alias("earnings_date"), T.prepared_part(F.col("transcript")).alias("prepared"), T.qa_part(F.col("transcript")).alias("qa"))
    return parts.select("symbol", "earnings_date", turns("prepared").alias("prepared"), turns("qa").alias("qa"))


def transcript_chunks(calls: DataFrame) -> DataFrame:
    """symbol, earnings_date, section_type, speaker_role, text, position of every chunk of transcripts (symbol,
    earnings_date, transcript)."""
    return by_batch(transcript_parts(calls), packed_turns, CHUNKS)


def release_chunks(calls: DataFrame) -> DataFrame:
    """Chunks of press releases (symbol, earnings_date, release) that are long enough. Every chunk has 30 characters."""
    kept = calls.filter(T.release_admitted(F.col("release"))).select(F.col("symbol").cast("string").alias("symbol"), F.col("earnings_date").cast("string").alias("earnings_date"), F.array_join(T.release_lines(F.col("release")), " ").alias("body"))
    return by_batch(kept, packed_releases, CHUNKS)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """paper_title, page_num, paragraphs of pages (paper_title, page_num, text)."""
    paragraphs = F.split(T.paper_text(F.col("text")), r"\n{2,}", -1)
    clean = F.transform(paragraphs, lambda p: T.stripped(F.array_join(F.filter(T.lines(T.stripped(p)), lambda x: ~T.paper_noise(x)), " ")))
    return pages.select(F.col("paper_title").cast("string").alias("paper_title"), F.col("page_num").cast("int").alias("page_num"), F.coalesce(clean, F.array().cast("array<string>")).alias("paragraphs"))


def paper_chunks(pages: DataFrame) -> DataFrame:
    """paper_title, page_num, text, position of every chunk of pages (paper_title, page_num, text)."""
    return by_batch(page_paragraphs(pages), packed_pages, PAPER_CHUNKS)


def with_chunk_ids(chunks: DataFrame, order: list[str], least: int = T.DROP_CHUNK) -> DataFrame:
    """Chunks of `least` characters or more with chunk_id 0, 1, 2... in order."""
    return with_position(chunks.filter(F.length("text") >= least), order, "chunk_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """section_type, speaker_role, n, mean_length."""
    return chunks.groupBy("section_type", "speaker_role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_length"))


def chunks_by_paper(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "paper_title")
