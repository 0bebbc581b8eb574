import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, lang string, row_id int, chunk string, part double, size int, term string, node long, score string, __score int, label int, place int, next boolean"


def rows(seed=5):
    """Documents with copies, near copies, shared passages, benchmark text, short, blank, null and long texts."""
    r = random.Random(seed)
    word = lambda: r.choice(["The", "river", "of", "stone", "Élan", "straße", "año", "x1", "and", "To"]) if r.random() < 0.5 else f"w{r.randint(0, 4000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    passage, bench = text(60), "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    out = [text(r.randint(8, 220)) for _ in range(40)]
    out += [out[0]] * 3 + [out[1].replace(" of ", "  of\n")]
    for k in range(12):  # near copies of one text
        words = out[2].split()
        words[(k * 13) % len(words)] = f"edit{k}"
        out.append(" ".join(words))
    out += [text(20) + " " + passage + " " + text(15) for _ in range(5)]
    out += [text(5) + ", " + bench.upper() + ". " + text(5), bench, "alpha beta gamma delta"]
    out += [None, "", "   \n", "one", "one two three", "To " * 80, "ab ab " * 60, text(6000), "|,.;", "<|endoftext|> and it's\x1c <|im_end|>"]
    langs = ["en", "fr", "de", None]
    return [(k, t, langs[k % 4], f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows that share doc_id, one pair equal and one not, and a null doc_id."""
    text = " ".join(f"t{k}" for k in range(50))
    return spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, text + " more", "en", "a", 1), (None, text, "fr", "b", 1), (2, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    made = [(k, t, lang, k, "c", 0.5, 1, "t", 7, "s", 3, 1, 2, True) for k, t, lang, _, _ in rows()[:20]]
    return spark.createDataFrame(made, CLASHING)
