import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import language_id, language_model, quality
from factorloom.llm.common import LOWER
from factorloom.llm.gru import TAILS, Gru, train

LANGS = {"en": "the of and to in is that for it was with as his on be at by".split(), "fr": "le la de et les des en un une du que dans qui par pour est".split(), "de": "der die und das von zu mit sich den auf für ist nicht ein eine".split()}


def words_of(text):
    return text.translate(LOWER).split()


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(LANGS[lang]) for _ in range(r.randint(5, 60))), lang, "s", 0) for k in range(400) for lang in [["en", "fr", "de"][k % 3]]]
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 34 !!", "fr", "s", 0), (1003, "die und das ist nicht mit der", None, "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_language_accuracy(spoken):
    rows = language_id.identify(spoken).join(spoken.select("doc_id", "lang"), "doc_id").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 404
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1003].lang_pred == "de"
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_predictions_by_hand(spark, spoken):
    """Every prediction again from the model's weights: n-grams as strings, shares by counting, softmax in plain floats."""
    rows = spoken.select("doc_id", "text", "lang").collect()
    model = language_id.train(spoken.filter(~language_id.held_out(4, 2)).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language_id.identify(spoken).collect()}
    m32 = 1 << 32

    def slot(gram):
        h = (ord(gram[0]) * 0x9E3779B1 + ord(gram[1])) * 0x85EBCA6B % m32
        return h >> 16 if len(gram) == 2 else (1 << 16) + ((h + ord(gram[2])) * 0xC2B2AE35 % m32 >> 16)

    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        said = f" {r.text.lower()} "
        grams = Counter(said[k : k + n] for n in (2, 3) for k in range(len(said) - n + 1))
        logits = [model.bias[j] + sum(n * float(model.table[model.row[slot(g)], j]) for g, n in grams.items()) / sum(grams.values()) for j in range(len(model.languages))]
        e = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        best = max(range(len(e)), key=e.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[best] and got[r.doc_id].score == pytest.approx(e[best] / sum(e), rel=1e-3)


def test_document_frequency_by_hand(spark, spoken):
    df, n = language_id.document_frequency(spoken.select("text"))
    texts = [(r.text or "").encode() for r in spoken.select("text").collect()]
    want = Counter(int(c) for t in texts for c in set(language_id.codes_of(t).tolist()))
    assert n == len(texts) and {k: int(df[k]) for k in np.flatnonzero(df)} == want


def test_ftrl_by_hand():
    """One coordinate at a time in plain floats gives the same weights."""
    r = random.Random(3)
    rows = [(sorted(r.sample(range(6), 3)), [r.random() for _ in range(3)], r.randrange(3)) for _ in range(40)]
    gain, alpha, beta, l1, l2, epochs = [1.0, 2.0, 0.5, 1.0, 3.0, 1.0], 0.5, 1.0, 0.05, 0.01, 2
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, j):
        return 0.0 if abs(z[i][j]) <= l1 else -(z[i][j] - math.copysign(l1, z[i][j])) / ((beta + math.sqrt(n[i][j])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, x, y = rows[k]
            features = [(i, v * gain[i]) for i, v in zip(f, x)] + [(6, 1.0)]
            s = [sum(v * weight(i, j) for i, v in features) for j in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for j in range(3):
                p = e[j] / sum(e) - (j == y)
                for i, v in features:
                    w, g = weight(i, j), v * p
                    z[i][j] += g - (math.sqrt(n[i][j] + g * g) - math.sqrt(n[i][j])) / alpha * w
                    n[i][j] += g * g
    got = language_id.ftrl([(np.array(f), np.array(x), y) for f, x, y in rows], 3, np.array(gain), alpha, beta, l1, l2, epochs)
    assert np.allclose(got, [[weight(i, j) for j in range(3)] for i in range(7)])


def test_letters_and_characters(spark):
    """Numbers that aren't letters have no language; two Han characters are enough to tell."""
    said = [("en", "the river and the sea"), ("ru", "река и море это вода"), ("zh", "河流和大海都是水")] * 40
    rows = [(k, t, lang) for k, (lang, t) in enumerate(said)] + [(500, "½ ² Ⅷ 12", None), (501, "大海", None), (502, "вода", None), (503, "\U0001f600", None), (504, "ª", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "zh", "ru", "und"] and got[504].lang_pred != "und"
    assert len(language_id.codes_of("海".encode())) == 3 and not len(language_id.codes_of(b""))


def test_every_language_is_learned(spark):
    """1,500 labels, each with letters of its own, all of which are predicted on held-out rows."""
    assert language_id.bits_for(4) == language_id.BITS and (2 << language_id.bits_for(1500)) * 1500 <= language_id.TABLE
    said = [(f"l{j:04}", "".join(chr(0x4E00 + 7 * j + k) for k in range(5))) for j in range(1500)]
    rows = [(12 * j + k, f"{t[k % 3:]} {t} {t[: 2 + k % 4]}", lang) for j, (lang, t) in enumerate(said) for k in range(12)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    want = {k: lang for k, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert len({r.lang_pred for r in got}) == 1500


def test_stretches_are_the_whole(monkeypatch):
    text = ("Ünd die Straße, 大海 ist nicht\n" * 40).encode()
    for bits in (16, 12):
        whole = sorted(language_id.codes_of(text, bits).tolist())
        for size in (1, 2, 7, 100):
            monkeypatch.setattr(language_id, "STRETCH", size)
            assert sorted(language_id.codes_of(text, bits).tolist()) == whole
            f, n = language_id.counted(text, bits)
            assert dict(zip(f.tolist(), n.tolist())) == Counter(whole)
        monkeypatch.setattr(language_id, "STRETCH", 1 << 20)


def test_language_of_a_very_long_text(spark):
    rows = [(k, f"{w} {w}s", lang) for k, (lang, w) in enumerate([("en", "the river"), ("de", "der strom")] * 30)] + [(1000, "the rivers " * 4_600_000, None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("doc_id = 1000").first()
    assert got.lang_pred == "en" and got.score > 0.5


def test_language_edges(empty, repeated, clashing, spark):
    assert language_id.identify(empty).collect() == []
    assert language_id.identify(repeated).count() == 5
    assert language_id.identify(clashing).count() == 20
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identify(unlabelled).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 4000)
    x = r.normal(size=(4000, 3))
    x[np.arange(4000), y] += 1.5
    assert 2.5 < language_id.temperature_of(5 * x * 1.5, y) / language_id.temperature_of(x * 1.5, y) < 8


def test_ftrl_is_sparse():
    r = np.random.default_rng(0)
    rows = [(np.array([y, 2 + r.integers(0, 40)]), np.ones(2), int(y)) for y in r.integers(0, 2, 300)]
    w = language_id.ftrl(rows, 2, np.ones(60), l1=1.0)
    assert w[0, 0] > 0 > w[1, 0] and (w[42:60] == 0).all() and (w[2:42] == 0).mean() > 0.3


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(2)
    good = lambda: ". ".join(" ".join(r.choice(["a", "river", "runs", "to", "the", "sea", "slowly", "today"]) + str(r.randint(0, 30)) for _ in range(8)) for _ in range(6)) + "."
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "$$$", "###", "|"]) for _ in range(50))
    rows = [(k, good() if k % 3 else bad(), int(bool(k % 3))) for k in range(300)] + [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")


def test_quality(judged):
    docs, labels = judged
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 302
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_learns_once_from_repeats(spark, judged):
    """Label rows that repeat, and documents that share an id, change nothing; what is fitted doesn't depend on the order."""
    docs, labels = judged
    hot = docs.limit(1).crossJoin(spark.range(500)).drop("id")
    want = quality.train(docs, labels, 40)
    got = quality.train(docs.unionByName(hot).repartition(7), labels.unionByName(labels).unionByName(labels.limit(3)).repartition(5), 40)
    assert (got.intercept, got.weighted) == (want.intercept, want.weighted)


def test_quality_edges(spark, judged, empty, repeated, clashing):
    _, labels = judged
    assert quality.score_quality(empty, labels).collect() == []
    assert quality.score_quality(repeated, labels).count() == 5
    assert quality.score_quality(clashing, labels.limit(0)).count() == 20
    one = spark.createDataFrame([(0, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score_quality(clashing, one).collect()} == {1}


def test_rules_match_their_column(spark, judged):
    docs, labels = judged
    model = quality.train(docs, labels)
    rows = quality.with_statistics(docs, ["doc_id"]).withColumn("p", model.column()).collect()
    x = np.array([[r[s] for s in quality.STATISTICS] for r in rows])
    by_hand = 1 / (1 + np.exp(-(model.intercept + sum(w * quality.applies(rule, x) for rule, w in model.weighted))))
    assert np.allclose(by_hand, [r.p for r in rows]) and model.weighted


def test_language_model(spark, docs):
    rows = language_model.score_documents(docs).collect()
    source = {r.doc_id: words_of((r.text or "").encode()) + [b""] for r in docs.collect()}
    c = Counter(w for k, ws in source.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(source)
    for r in rows:
        ws = source[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    held = [r for r in rows if r.held_out]  # words at random: there is nothing to learn, and little is lost
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_language_model_learns(spoken):
    """On texts of three languages the model gains what a unigram model can't."""
    held = [r for r in language_model.score_documents(spoken).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_language_model_edges(spark, empty, repeated, clashing):
    assert language_model.score_documents(empty).collect() == []
    got = language_model.score_documents(repeated).collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.doc_id == 2} == {1}
    assert language_model.score_documents(clashing).count() == 20
    k = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only_held = spark.createDataFrame([(k, "no training rows")], "doc_id long, text string").collect()
    r = language_model.score_documents(spark.createDataFrame(only_held)).first()
    assert (r.train_tokens, r.n_tokens, r.base_score, r.score) == (0, 4, 0.0, 0.0)


def exact_counts(rows, got):
    tokens = {k: words_of((t or "").encode()) + [b""] for k, t in rows}
    c = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_few_very_long_texts(spark):
    """The end token is rare among very many words of equal count: counts and scores stay right."""
    few = [(0, " ".join(f"w{k}" for k in range(40_000) for _ in range(2))), (1, " ".join(f"x{k}" for k in range(40_000))), (2, "w1 x1 new")]
    for rows in (few[:1], few[:2], few):
        exact_counts(rows, language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_language_model_learns_every_token(spark, monkeypatch):
    """The weights learn from all training tokens once a corpus is above FLOOR, whatever its texts' lengths, rows that
    repeat and null ids and texts included."""
    monkeypatch.setattr(language_model, "FLOOR", 2_000)
    monkeypatch.setattr(language_model, "SHARD", 2_000)
    monkeypatch.setattr(language_model, "CHUNK", 70)
    r = random.Random(8)
    rows = [(k, " ".join(r.choice("the a river sea runs to slowly and stone".split()) for _ in range(r.choice([0, 1, 30, 200, 900])))) for k in range(300)]
    rows += [rows[5]] * 3 + [(None, "no id"), (900, None)]
    chunks, counted = language_model.chunks_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    words = language_model.vocabulary_of(counted.filter("chunk is null"))
    want = sum(len((t or "").split()) + 1 for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2 or k is None)
    assert words.n == want and want > 20_000
    assert language_model.fitted(chunks, words)[1] == want


def test_scores_hold(spark, spoken):
    """Shards and averages don't depend on how rows were dealt out."""
    one = {r.doc_id: r.score for r in language_model.score_documents(spoken).collect()}
    other = {r.doc_id: r.score for r in language_model.score_documents(spoken.repartition(9)).collect()}
    assert one == pytest.approx(other, rel=1e-5)


def test_model_is_a_distribution():
    """Over head words and tail classes, probabilities after any history sum to 1."""
    model = Gru.new(70)
    model.start_biases(np.arange(1, 71 + TAILS))
    history = np.array([3, 69, 71, 5])
    every = [np.append(history, w).astype(np.int32) for w in range(70 + TAILS)]
    none = [np.zeros(5)] * len(every)
    prefix = model.score([history.astype(np.int32)], 0, [np.zeros(4)])[0]
    assert np.exp(model.score(every, 0, none) - prefix).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_across_windows():
    """A long text's score is the sum of its steps, whatever the windows and the texts beside it."""
    model = Gru.new(40)
    r = np.random.default_rng(4)
    long = r.integers(0, 40, 3000).astype(np.int32)
    others = [r.integers(0, 40, k).astype(np.int32) for k in (0, 1, 50, 700)]
    alone = model.score([long], 0, [np.zeros(3000)])[0]
    beside = model.score([others[0], others[3], long, others[1], others[2]], 0, [np.zeros(1)] * 5)[2]
    h, before, total = np.zeros((1, 16), np.float32), 0, 0.0
    for w in long:
        h = model.step(h, (model.p["x"] + model.p["b"])[[before]])[0]
        total += model.log_probability(h, np.array([w]))[0]
        before = w
    assert alone == pytest.approx(beside, rel=1e-4) and alone == pytest.approx(total, rel=1e-4)


def test_training_is_the_gradient():
    """One step in one window is Adam's first: each weight moves against the sign of the loss's numerical gradient."""
    model, texts = Gru.new(9, 3), [np.array([1, 2, 8, 3, 40, 5], np.int32), np.array([4, 1, 7, 6], np.int32)]
    loss = lambda m: -m.score(texts, 0, [np.zeros(1)] * 2).sum()
    after = model.unpacked(model.packed())
    assert train(after, texts, 0, 0, 10, 1, streams=1, rate=1e-3) == 10
    for key in ("u", "x", "c", "w", "b", "cb"):
        moved = (after.p[key] - model.p[key]).reshape(-1)
        for k in np.random.default_rng(1).permutation(np.flatnonzero(moved))[:8]:
            slope = []
            for by in (0.02, -0.02):
                other = model.unpacked(model.packed())
                other.p[key].reshape(-1)[k] += by
                slope.append(loss(other))
            if abs(slope[0] - slope[1]) > 2e-4:
                assert np.sign(slope[0] - slope[1]) == -np.sign(moved[k]), key


def test_training_gradient():
    """Training lowers the loss on a pattern that needs the state."""
    model = Gru.new(6)
    texts = [np.array([1, 2, 3, 1, 2, 4] * 5, np.int32) for _ in range(20)]
    before = model.score(texts, 0, [np.zeros(30)] * 20).sum()
    assert train(model, texts * 64, 0, 0, 38400, 1, streams=8) == 38400
    assert model.score(texts, 0, [np.zeros(30)] * 20).sum() > 0.25 * before
