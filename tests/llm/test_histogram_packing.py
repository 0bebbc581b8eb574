import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorloom.llm import histogram_packing as hp


def laid_out(histogram, grid):
    """Tokens of each sequence, every document's cuts, from a plan's parts."""
    made, filled, cuts = hp.plan(histogram, grid), defaultdict(list), defaultdict(list)
    for _, length, first, n, a, b, sequence, each, offset in made.rows:
        for k in range(n):
            filled[sequence + k // each].append((offset + k % each * (b - a), b - a))
            cuts[length, first + k].append((a, b))
    return made, filled, cuts


def check(histogram, grid=4):
    most = len(histogram) - 1
    made, filled, cuts = laid_out(histogram, grid)
    assert sorted(filled) == list(range(made.sequences))
    for slots in filled.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= most
    assert set(cuts) == {(n, k) for n in range(1, most + 1) for k in range(histogram[n])}
    for (length, _), parts in cuts.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == length and all(x[1] == y[0] and y[0] % grid == 0 for x, y in zip(parts, parts[1:]))
    return made, filled, cuts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 60)), max_size=12))
def test_every_token_has_one_place(counts):
    histogram = np.zeros(65, np.int64)
    for length, n in counts:
        histogram[length] += n
    check(histogram)


def one_by_one(lengths, most):
    """Documents longest first, each to the pack with the most space, or a new one where none holds it."""
    free = []
    for n in sorted(lengths, reverse=True):
        k = max(range(len(free)), key=free.__getitem__, default=None)
        if k is None or free[k] < n:
            free.append(most)
            k = len(free) - 1
        free[k] -= n
    return sorted(free)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 48), st.integers(1, 9)), min_size=1, max_size=10))
def test_packs_are_those_of_single_placements(counts):
    histogram = np.zeros(49, np.int64)
    for length, n in counts:
        histogram[length] += n
    got = sorted(free for free, some in enumerate(hp.shortest_pack_first(histogram)) for p in some for _ in range(p.count))
    assert got == one_by_one([n for n in range(49) for _ in range(histogram[n])], 48)


def test_one_length_over_half_a_sequence_is_cut():
    histogram = np.zeros(4097, np.int64)
    histogram[2100] = 3001
    made, filled, cuts = check(histogram, hp.GRID)
    assert made.sequences * 4096 < 1.02 * 2100 * 3001 and max(map(len, cuts.values())) <= 5


def test_powers_of_two_stay():
    histogram = np.zeros(4097, np.int64)
    histogram[2048] = 7
    assert {sum(n for _, n in x) for x in check(histogram, hp.GRID)[1].values()} == {4096, 2048}


def brute(texts, end=2):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def verify(rows, documents, most, padding):
    """Every id of every document lies in one piece, sequences have no gaps, and little is padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for doc_id, some in by_doc.items():
        ids, at = documents[doc_id], 0
        for r in sorted(some, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    wasted = 0
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
        wasted += most - at if at & (at - 1) else 0
    assert wasted <= padding


def test_documents(spark, docs, clashing):
    for table in (docs, clashing):
        rows = table.collect()
        verify(hp.pack_documents(table).collect(), dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]))), 4096, 4096)


def test_cut_documents_keep_their_checksums(spark, monkeypatch):
    monkeypatch.setattr(hp, "SALTED", 7)  # many salts
    texts = [f"w{k} " * 37 + "tail" * (k % 3) for k in range(150)] + [None, "", "one", "x " * 1000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    documents = dict(enumerate(brute(texts)))
    for most in (128, 256):
        verify(hp.pack_documents(table, most=most, grid=8).collect(), documents, most, 0.1 * sum(map(len, documents.values())))


def test_repeated_rows_and_empty_table(spark, repeated, empty):
    texts = {k: len(x) for k, x in zip("abc", brute([f"{' '.join(f't{k}' for k in range(50))}{more}" for more in ("", " more")]))}
    got = hp.pack_documents(repeated).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in got) == sorted([(False, 1, texts["a"])] * 2 + [(False, 1, texts["b"]), (True, 0, texts["a"]), (False, 2, 1)])
    assert hp.pack_documents(empty).collect() == []


def test_long_text_by_stretches():
    from factorloom.llm.packing import Encoder

    encoder = Encoder.of(public_tokenizers.path("word_bpe_49k.json"))
    text = "A comma, and a stop. <|endoftext|> Élan\n" * 60_000
    assert len(text) > 2 << 20
    assert encoder.encode([text.encode(), b"b"], 2) == [x.tobytes() for x in brute([text, "b"])]


@pytest.mark.parametrize("size", [1, 31, 32, 33, 64, 100])
def test_checksums(size):
    ids = np.arange(7, 7 + size, dtype="<u4")
    crc, marks = hp.checksums(ids.tobytes(), 32)
    marks = np.frombuffer(marks, "<u4")
    assert crc == zlib.crc32(ids.tobytes()) and len(marks) == (size - 1) // 32
    for k, m in enumerate(marks, 1):
        assert hp.checksum_of_rest(crc, int(m), 4 * (size - 32 * k)) == zlib.crc32(ids[32 * k :].tobytes())
