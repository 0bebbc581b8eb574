import random

import pytest

from factorloom.llm import jaccard_join as jj
from factorloom.llm.common import LOWER


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    """doc_id, n_shingles, component_id, n_links of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jj.similar_groups(docs).collect())
    assert got == brute(rows)


def edited(words, edits, r):
    words = words[:]
    for k in r.sample(range(len(words)), edits):
        words[k] = f"e{r.randint(0, 40)}"
    return words


def test_matches_brute_force(docs):
    check(docs)


@pytest.mark.parametrize("split, follows, heads", [(4096, 40, 24), (2, 40, 24), (3, 100, 24), (4096, 70, 2)])
def test_large_groups_and_common_lines(spark, monkeypatch, split, follows, heads):
    """Near copies of one text with few and many edits, chains of copies, and lines that dissimilar texts share."""
    monkeypatch.setattr(jj, "SPLIT", split)
    monkeypatch.setattr(jj, "FOLLOWS", follows)
    monkeypatch.setattr(jj, "HEADS", heads)
    r, out = random.Random(3), []
    base = [f"b{k}" for k in range(90)]
    out += [" ".join(edited(base, r.randint(0, 4), r)) for _ in range(60)]
    out += out[:7] * 2
    some = [edited(base, 3, r) for _ in range(3)]  # copies of copies
    out += [" ".join(edited(r.choice(some), r.randint(0, 2), r)) for _ in range(30)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
        out.append(" ".join(chain))
    line = " ".join(f"L{k}" for k in range(14))
    out += [" ".join(f"q{r.randint(0, 10**6)}" for _ in range(r.choice([1, 2, 3, 30]))) + " " + line for _ in range(30)]
    out += [line + " " + " ".join(f"s{r.randint(0, 6)}" for _ in range(3)) for _ in range(30)]
    check(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(4))


def test_one_shingle_in_many_sets_of_like_size(spark, monkeypatch):
    """A hot list whose sets are otherwise pairwise apart, beside pairs that are similar."""
    monkeypatch.setattr(jj, "SPLIT", 50)
    r, out = random.Random(8), []
    pool = [" ".join(f"p{k}_{i}" for i in range(9)) for k in range(40)]
    for _ in range(220):
        out.append("the very same line of text " + " | ".join(r.sample(pool, 4)))
    out += [t + " x" for t in out[:20]]
    check(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3))


def test_any_sets(spark):
    """Small alphabets give sets of every overlap, thresholds met exactly included."""
    for seed in range(3):
        r = random.Random(seed)
        out = [" ".join(r.choice("abc") for _ in range(r.randint(3, 14))) for _ in range(150)]
        check(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3))


def test_edges(spark, repeated, empty, clashing):
    check(repeated.filter("doc_id is not null"))
    got = jj.similar_groups(repeated).collect()
    assert len(got) == 5 and {(r.component_id, r.n_links) for r in got if r.n_shingles} == {(1, 3)}
    check(clashing)
    assert jj.similar_groups(empty).collect() == []
    check(spark.createDataFrame([(5, None), (6, ""), (3, " "), (9, "a b"), (8, "A  b"), (7, "a c")], "doc_id long, text string"))


def test_a_very_long_text(spark):
    """One text of some 5 MB among short ones, and a near copy of it."""
    r = random.Random(2)
    long = [f"w{r.randint(0, 10**7)}" for _ in range(600_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["new", *long[1000:]])), (3, "a short text of a few words"), (4, "a short text of a few words"), (5, None)]
    got = {x.doc_id: (x.component_id, x.n_links) for x in jj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}
