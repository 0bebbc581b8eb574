import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm.common import word_hashes
from factorloom.llm.substring_dedup import ROUNDS, recompress, remove_repeats


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def check(docs, window=35):
    rows = docs.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text for r in rows], window)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, window).collect()) == want
    return want


def test_matches_brute_force(docs):
    assert sum(x[2] for x in check(docs)) > 500


def test_small_window(docs):
    check(docs, 12)


def test_a_very_long_text(spark):
    """One text of some 8 MB among short ones, dealt by a shuffle: it shares a passage with a short text and with itself."""
    words = [f"w{k * 7919 % 900_001}" for k in range(900_000)]
    passage = [f"p{k}" for k in range(40)]
    long = words[:500_000] + passage + words[500_000:] + words[100:160]
    rows = [(1, " ".join(long)), (2, "a " + " ".join(passage[1:]) + " b")] + [(k, f"short text {k}") for k in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(docs).collect()}
    assert got[1] == (900_100, 39 + 120) and got[2] == (41, 39) and all(got[k] == (3, 0) for k in range(3, 40))


def test_edges(repeated, empty, clashing):
    check(repeated)
    check(clashing)
    assert remove_repeats(empty).collect() == []
    kept = {r.kept_text for r in remove_repeats(repeated, text=True).collect()}
    assert kept == {"", "more"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd", b"e"]), min_size=40, max_size=80), st.integers(0, 30), st.integers(0, 30))
def test_equal_windows_share_symbols(core, before, after):
    """A symbol whose context lies inside an equal part has the same name and place in both texts."""
    left = [b"l%d" % k for k in range(before)] + core
    right = core + [b"r%d" % k for k in range(after)]
    found = []
    for words, shift in ((left, before), (right, 0)):
        x = recompress(word_hashes(words), np.zeros(len(words), np.int64), ROUNDS)
        inside = (x["low"] >= shift) & (x["high"] <= shift + len(core))
        found.append({(int(lo) - shift, int(hi) - shift, int(n)) for lo, hi, n in zip(x["low"][inside], x["high"][inside], x["name"][inside])})
    assert found[0] == found[1]
