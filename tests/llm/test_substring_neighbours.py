import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm.common import word_hashes
from factorloom.llm.substring_dedup import ROUNDS, recompress

WORD = st.sampled_from([b"a", b"b", b"c", b"dd", b"e"])


def shared(core, before, after):
    words = before + core + after
    x = recompress(word_hashes(words), np.zeros(len(words), np.int64), ROUNDS)
    low, high = x["low"] - len(before), x["high"] - len(before)
    inside = (low >= 0) & (high <= len(core))
    return set(zip(low[inside].tolist(), high[inside].tolist(), x["name"][inside].tolist()))


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=20, max_size=60), st.tuples(*[st.lists(WORD, max_size=4)] * 4))
def test_neighbours_of_the_same_alphabet(core, beside):
    """The symbols inside a passage are the same whatever words, its own edge words among them, stand beside it."""
    assert shared(core, beside[0], beside[1]) == shared(core, beside[2], beside[3])


def test_passage_beside_its_edge_word(spark):
    """Passages of exactly a window are removed whole if one copy stands beside its own first or last word."""
    from tests.llm.test_substring_dedup import check

    rows = []
    for k in range(40):
        core = [f"p{k}x{i}" for i in range(35)]
        other = [core[0], *core] if k % 2 else [*core, core[-1]]
        rows += [f"x{k} {' '.join(core)} y{k}", f"u{k} {' '.join(other)} v{k}"]
    found = check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sum(x[2] for x in found) == 40 * 2 * 35
