import hashlib
import re

from factorloom.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [("a1", "Alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("a2", "one"), ("a3", None), ("a4", "..."), ("a5", "alpha beta gamma delta epsilon zeta eta theta iota kappa"), ("a1", "one")]


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        for k in range(max(len(i) - width + 1, 1 if i else 0)):
            win = i[k : k + width]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items):
    got = sorted(tuple(r) for r in dc.contaminated_words(docs, spark.createDataFrame(items, "item_id string, text string")).collect())
    want = sorted((r.doc_id, *brute(r.text, items)) for r in docs.collect())
    assert got == want


def test_matches_brute_force(spark, docs):
    check(spark, docs, ITEMS)


def test_shuffled_paths_match(spark, docs, monkeypatch):
    for name in ("VOCABULARY", "PHRASES", "ROWS"):
        monkeypatch.setattr(dc, name, 1)
    check(spark, docs, ITEMS)


def test_edges(spark, repeated, empty, clashing):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = [r for r in dc.contaminated_words(repeated.fillna(-1, ["doc_id"]), items).collect()]
    assert len(got) == 5
    assert sorted(r.n_words for r in got) == [0, 50, 50, 50, 51]
    assert dc.contaminated_words(repeated, items).count() == 5
    assert dc.contaminated_words(empty, items).collect() == []
    none = dc.contaminated_words(clashing, items.limit(0)).collect()
    assert len(none) == 20 and not any(r.contaminated for r in none)


def test_a_very_long_text(spark):
    """One text of some 5 MB among short ones, dealt by a shuffle, with a window at its end."""
    rows = [(1, " ".join(f"w{k % 1000}" for k in range(1_000_000)) + " " + ITEMS[4][1])] + [(k, "short one" if k == 5 else "short text") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in dc.contaminated_words(docs, spark.createDataFrame(ITEMS, "item_id string, text string")).collect()}
    assert got[1] == (1_000_010, 10, 2) and got[5] == (2, 1, 2) and got[6] == (2, 0, 0)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big fox jumps"), (2, "big red fox jumps"), (3, "red fox"), (4, "jumps far away from the red old big fox")], "doc_id long, text string")
    items = dc.sequences(spark.createDataFrame([("p", "red big fox jumps")], "item_id string, text string")).select("sequence", "words")
    index = dc.stored(dc.build_index(dc.with_ids(docs)), "index")
    by = lambda slop: {r.row_id for r in dc.find(index, items, 10, slop).join(index.filter("term = ''").select("row_id", "doc_id"), "row_id").select("doc_id").withColumnRenamed("doc_id", "row_id").collect()}
    assert by(0) == {1}
    assert by(1) == {1, 2}


def test_proximity_matches_brute_force(spark, docs, tmp_path):
    """Windows whose every word is at most one place off, by trying all starts, on texts with swapped and shifted words."""
    from factorloom.llm import registry

    bench = words(ITEMS[0][1])
    swapped = bench[:3] + [bench[4], bench[3]] + bench[5:]
    texts = [r.text for r in docs.collect()][:30] + [" ".join(["x", *swapped, "y"]), " ".join(bench[:5] + ["new"] + bench[5:]), " ".join(bench[:4] + bench[5:]), " ".join(reversed(bench)), "one", "two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    windows = {(tuple(i), k, tuple(i[k : k + 10])) for _, t in ITEMS for i in [words(t)] for k in range(max(len(i) - 9, 1 if i else 0))}

    def near(text):
        w = words(text)
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, set()).add(p)
        fits = lambda win, s: all(any(s + o + d in at.get(x, ()) for d in (-1, 0, 1)) for o, x in enumerate(win))
        return sum(any(fits(win, s) for s in range(-1, len(w) + 1)) for _, _, win in windows)

    got = {r.doc_id: r.n_near for r in registry.proximity_search(spark, str(tmp_path)).collect()}
    assert got == {k: near(t) for k, t in enumerate(texts)}
    assert got[30] > 0 and got[31] > 0 and got[34] == 1
