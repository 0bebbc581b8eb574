import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.operators import chunking as ch


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\n", "", "\n", "x\x0by\x0cz\x1cq\x85w e", "a\n\n"])
def test_lines_are_splitlines(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()


@pytest.mark.parametrize("text,line", [("hello\nQuestions and Answers\nx", 1), ("a\n Q&A \nb", 1), ("We will now begin the question session", 0), ("nothing", None), ("  ", None), (None, None), ("a\nI turn the call over for Q&A", 1)])
def test_qa_boundary(spark, text, line):
    assert one(spark, text, T.qa_line) == line
    if line is not None:
        assert one(spark, text, T.qa_part) == "\n".join(text.splitlines()[line:]).strip() and one(spark, text, T.prepared_part) == "\n".join(text.splitlines()[:line]).strip()


@pytest.mark.parametrize("said,role", [("", "unknown"), (None, "unknown"), ("Q - Jo", "analyst"), ("Operator", "operator"), ("Al, Goldman Sachs", "analyst"), ("Al, CFO", "mgmt"), ("Al", "mgmt"), ("Operator of Morgan", "operator")])
def test_roles(spark, said, role):
    assert one(spark, said, T.speaker_role) == role


@pytest.mark.parametrize("line,noise", [("", True), ("FORM 8-K", True), ("see a.htm", True), ("x" * 200 + " a.pdf", False), ("1234567890 12345 67890 a", True), ("$1,2,3,4", True), ("We grew 5% this year", False)])
def test_release_noise(spark, line, noise):
    assert one(spark, line, T.release_noise) == noise


def test_score_lines(spark):
    got = one(spark, "1: 2\n 2 : -9\n1: +1.5\nx: 3\n3: abc\n4:0", lambda c: T.score_lines(c, -2, 2))
    assert got == {1: 1.5, 2: -2.0, 4: 0.0}
    assert one(spark, "no 7.5 or 3", lambda c: T.first_number(c, -2, 2)) == 2.0 and one(spark, "none", lambda c: T.first_number(c, -2, 2)) is None


@pytest.mark.parametrize("name,want", [("ok_name", "ok_name"), ("Bad Name!", "bad_name"), ("__X--y__", "x_y")])
def test_names(spark, name, want):
    assert one(spark, name, T.feature_name) == want


def test_tokens_and_truncation(spark):
    text = "营收" * 10 + "a" * 41
    assert one(spark, text, T.token_estimate) == int(20 * 1.5 + 41 / 4) and one(spark, None, T.token_estimate) == 0
    assert one(spark, "a" * 400, lambda c: T.truncated(c, 50)) == "a" * 180 + "\n\n[...truncated...]" and one(spark, "abc", lambda c: T.truncated(c, 50)) == "abc"


def test_paper_text(spark):
    text = "word-\nend of\nline\nNext  para\n\nnew"
    want = re.sub(r" {2,}", " ", re.sub(r"(?<!\n)\n(?!\n)(?![A-Z\d])", " ", re.sub(r"-\n([a-z])", r"\1", text))).strip()
    assert one(spark, text, T.paper_text) == want


def test_masks_and_errors(spark):
    df = spark.createDataFrame([({"API_KEY": "v", "token": "t", "_x": "1", "long": "z" * 300},)], "m map<string,string>").select(T.sanitised(F.col("m")).alias("s")).first().s
    assert df == {"API_KEY": "***", "token": "***", "long": "z" * 200 + "..."}
    got = spark.createDataFrame([("ReadTimeout", None), ("ValueError", "please TRY AGAIN"), ("KeyError", "k")], "n string, m string").select(T.retryable(F.col("n"), F.col("m")).alias("r")).collect()
    assert [r.r for r in got] == [True, True, False]


def whole(spark, transcript):
    df = spark.createDataFrame([("S", "2020-01-01", transcript)], "symbol string, earnings_date string, transcript string")
    return ch.transcript_chunks(df).orderBy("position").collect()


def test_transcript_turns(spark):
    text = "intro dropped\nSue Roe, CFO: " + "We had a good year. " * 8 + "\nOperator: thanks\nBob Lee: " + "ok. " * 30 + "\nQuestions and Answers\nAnn, Morgan Stanley: " + "what of margins? " * 10
    rows = whole(spark, text)
    assert [(r.section_type, r.speaker_role) for r in rows] == [("prepared", "mgmt"), ("prepared", "operator"), ("prepared", "mgmt"), ("prepared", "analyst")]
    assert "intro dropped" not in " ".join(r.text for r in rows)
    assert whole(spark, "") == [] and whole(spark, None) == []


def test_short_turns_wait(spark):
    rows = whole(spark, "Al Bee: short one\nCy Dee: " + "x" * 120 + "\nEd Eff: tiny")
    assert [r.text for r in rows] == ["short one", "x" * 120]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab. ?", min_size=0, max_size=400), max_size=6))
def test_pack_keeps_limits(texts):
    pieces = [t.strip() for t in texts if t.strip()]
    unit, last, first, packed = ch.pack(np.zeros(len(pieces), int), pa.array(pieces, pa.string()), 20, 100, 5)
    out = packed.to_pylist()
    assert len(unit) == len(last) == len(first) == len(out) and all(len(t) <= 100 + 20 for t in out)
    # nothing is lost but a last waiting text of fewer than 5 characters; waiting texts may come after a later cut
    letters = lambda texts: sorted("".join("".join(t.split()) for t in texts))
    lost = len(letters(pieces)) - len(letters(out))
    assert 0 <= lost < 5


def test_sentence_cut():
    assert ch.heads_of("a" * 60 + ". " + "b" * 60, 100) == (["a" * 60 + "."], "b" * 60)
    assert ch.heads_of("a" * 10 + ". " + "b" * 200, 100) == (["a" * 10 + ". " + "b" * 88, "b" * 100], "b" * 12)


def test_release_chunks(spark):
    body = "Form 8-K\n" + "\n".join(f"Revenue rose in quarter {k} on strong demand across regions." for k in range(60))
    df = spark.createDataFrame([("A", "d", body), ("B", "d", "short"), ("C", "d", None), ("D", "d", "y" * 499)], "symbol string, earnings_date string, release string")
    rows = ch.release_chunks(df).collect()
    assert {r.symbol for r in rows} == {"A"} and all(30 <= len(r.text) <= 1600 for r in rows) and len(rows) == 3
    assert all("Form 8-K" not in r.text for r in rows)


def test_paper_chunks(spark):
    paragraphs = ["tiny", "m" * 60, "n" * 200, "o" * 1195, "p" * 100, "q. " * 900, "r" * 149]
    df = spark.createDataFrame([("t", 1, "\n\n".join(paragraphs)), ("t", 2, None)], "paper_title string, page_num int, text string")
    rows = [r.text for r in ch.paper_chunks(df).orderBy("position").collect()]
    assert rows[0] == "m" * 60 + " " + "n" * 200 and rows[1] == "o" * 1195 and rows[2] == "p" * 100
    assert all(len(t) <= 1200 for t in rows) and "r" * 149 not in rows


def test_chunk_ids(spark):
    df = spark.createDataFrame([("b", 1, "x" * 40), ("a", 2, "x" * 40), ("a", 1, "x" * 29), ("a", 3, "x" * 30)], "f string, p int, text string")
    assert {(r.f, r.p): r.chunk_id for r in ch.with_chunk_ids(df, ["f", "p"]).collect()} == {("a", 2): 0, ("a", 3): 1, ("b", 1): 2}
