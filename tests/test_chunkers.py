"""The chunkers against a plain reading of their rules, on whole tables."""

import re

import pytest

from factorloom.functions import text as T
from factorloom.operators import chunking
from factorloom.plans import catalogue
from factorloom.plans import domain as D

SF = "/root/testdata/sf0.001"
MARK = re.compile(r"[.?!] ")


def heads_and_rest(text, most):
    """What is cut off the front of a text, piece by piece, and what is left."""
    heads = []
    while len(text) > most:
        ends = [m.start() for m in MARK.finditer(text[:most])]
        size = ends[-1] + 1 if ends and ends[-1] > most // 2 else most
        heads.append(text[:size])
        text = text[size:].strip()
    return heads, text


class Waiting(list):
    """Short texts with their labels, as one text."""

    def __str__(self):
        return " ".join(t for _, t in self)


def packed(turns, least, most, drop):
    """(section, role, text) of turns (section, role, text)."""
    out, waiting, section = [], Waiting(), None
    for sec, role, text in turns:
        heads, rest = heads_and_rest(text, most)
        for head in heads:
            if waiting and len(str(waiting)) + len(head) > most:
                out.append((section, waiting[0][0], str(waiting)))
                waiting = Waiting()
            out.append((sec, role, head.strip()))
            section = sec
        if rest and len(rest) < least:
            waiting.append((role, rest))
            section = sec
        elif rest:
            if waiting:
                out.append((section, waiting[0][0], str(waiting)))
                waiting = Waiting()
            out.append((sec, role, rest))
            section = sec
    if len(str(waiting)) >= drop:
        out.append((section, waiting[0][0], str(waiting)))
    return out


def section_of(text):
    return "qa" if any(w in text.lower() for w in T.QA_WORDS) else "prepared"


def role_of(speaker):
    if not speaker:
        return "unknown"
    if re.search(T.ANALYST_PREFIX, speaker):
        return "analyst"
    return "operator" if "operator" in speaker.lower() else "analyst" if re.search(T.ANALYST_FIRMS, speaker) else "mgmt"


def turns_of(text):
    if not text.strip():
        return []
    found = list(re.finditer(T.SPEAKER_TURN, text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    said = [(m[1].strip(), text[m.end() : end].strip()) for m, end in zip(found, ends)] if found else [("", text.strip())]
    return [(section_of(t), role_of(who), t) for who, t in said if t]


def transcript(text):
    lines = (text or "").split("\n")
    at = next((k for k, x in enumerate(lines) if any(re.search(p, x) for p in T.QA_BOUNDARY)), None)
    parts = [text or ""] if at is None else ["\n".join(lines[:at]), "\n".join(lines[at:])]
    return [c for p in parts for c in packed(turns_of(p.strip()), T.MIN_CHUNK, T.MAX_CHUNK, T.DROP_CHUNK)]


def noise(line):
    s = line.strip()
    if not s:
        return True
    letters = sum(map(str.isalpha, s)) / len(s)
    return bool(
        len(s) < 120 and re.search(T.RELEASE_NOISE, s) or len(s) < 200 and re.search(T.FILE_NAME, s) or len(s) > 20 and letters < 0.25
        or s[0] in "$(-0123456789" and s.count("$") + s.count(",") > 3
    )


def release(text):
    if not (text or "").strip() or len(text) < T.RELEASE_LEAST:
        return []
    body = " ".join(x.strip() for x in text[: T.RELEASE_HEAD].splitlines() if not noise(x))
    return [t for _, _, t in packed([("p", "-", body)], T.MIN_CHUNK, T.MAX_CHUNK, T.DROP_CHUNK) if len(t) >= T.DROP_CHUNK]


def cleaned(text):
    for pattern, to in ((r"-\n([a-z])", r"\1"), (r"(?<!\n)\n(?!\n)(?![A-Z\d])", " "), (r" {2,}", " ")):
        text = re.sub(pattern, to, text)
    return text.strip()


def paper(text):
    out, waiting = [], ""
    for part in re.split(r"\n{2,}", cleaned(text or "")):
        p = " ".join(x for x in part.strip().splitlines() if not re.search(T.PAPER_NOISE, x.strip())).strip()
        if len(p) < T.PAPER_DROP:
            continue
        joined = f"{waiting} {p}".strip()
        if len(p) < T.PAPER_MIN:
            waiting = joined
            continue
        if waiting and len(joined) <= T.PAPER_MAX:
            out.append(joined)
        else:
            heads, rest = heads_and_rest(p, T.PAPER_MAX)
            out += [waiting] * bool(waiting) + [h.strip() for h in heads] + [rest] * (not heads or len(rest) >= T.PAPER_MIN)
        waiting = ""
    return out + [waiting] * (len(waiting) >= T.PAPER_MIN)


def nasty():
    """Texts that meet every rule: cuts with and without sentence ends, turns that wait, boundaries, noise, blanks."""
    long = "We had a good year. " * 120
    return [
        None, "", " \n ", "no speaker at all " * 10, f"Sue Roe, CFO: {long}\nOperator: thanks\nBob Lee: {'ok. ' * 30}\nQuestions and Answers\nAnn, Morgan Stanley: {'what of margins? ' * 10}",
        f"Al Bee: short one\nCy Dee: {'x' * 120}\nEd Eff: tiny", f"Al Bee: {'wait ' * 15}\nCy Dee: {'y' * 3300}\nEd Eff: {'z ' * 900}", "intro\nOperator: a\nOperator: b\nOperator: " + "c" * 40, f"Q and A\n{long}",
        f"Al Bee: {'w' * 90}\nCy Dee: {'v' * 1590}. tail", f"Mr. One: {'first. ' * 12}\nMs. Two: {'second! ' * 400}\nMr. Three: end",
        f"Operator: {'please go ahead with your question ' * 6}\nAnn Lee: {'we think so. ' * 130}\nOperator: thank you, operator",
    ]


@pytest.fixture(scope="module")
def texts(spark):
    documents = [r.text for r in D.table(spark, SF, "documents").select("text").collect()]
    calls = [r.transcript for r in D.calls(spark, SF).collect()]
    lines = ["Form 8-K", "see report.pdf", "$1,2,3,4 12,000", "(12) 3,4,5,6,7", "1234567890123456789012345 a", "", "Table of Contents"]
    mixed = ["\n".join(x for k, line in enumerate(lines) for x in (t[60 * k : 60 * k + 60], line)) + t[420:] for t in documents[:60] if t]
    pages = ["word-\nbreak and Line\nnext\n2 two\n\n" + "m" * 60 + "\n\n" + "n" * 200 + "\n\nAbstract\n\n" + "p. " * 900 + "\n\n" + "o" * 149, "q" * 1195 + "\n\n" + "r" * 100 + "\n\n" + "s" * 1160 + "\n\ndoi:10.1\nkept line " + "t" * 160]
    return documents + calls + mixed + pages + nasty()


def chunks_of(spark, texts, name, chunks, key):
    df = spark.createDataFrame([(str(k), "d", t) for k, t in enumerate(texts)], f"symbol string, earnings_date string, {name} string")
    found = {}
    for r in chunks(df).orderBy("symbol", "position").collect():
        found.setdefault(int(r.symbol), []).append(key(r))
    return [found.get(k, []) for k in range(len(texts))]


def test_transcripts(spark, texts):
    got = chunks_of(spark, texts, "transcript", chunking.transcript_chunks, lambda r: (r.section_type, r.speaker_role, r.text))
    assert got == [transcript(t) for t in texts]
    assert sum(map(len, got)) > len(texts) and {s for x in got for s, _, _ in x} == {"prepared", "qa"}


def test_releases(spark, texts):
    got = chunks_of(spark, texts, "release", chunking.release_chunks, lambda r: r.text)
    assert got == [release(t) for t in texts]


def test_papers(spark, texts):
    df = spark.createDataFrame([("t", k, t) for k, t in enumerate(texts)], "paper_title string, page_num int, text string")
    found = {}
    for r in chunking.paper_chunks(df).orderBy("page_num", "position").collect():
        found.setdefault(r.page_num, []).append(r.text)
    assert [found.get(k, []) for k in range(len(texts))] == [paper(t) for t in texts]


def test_queries_cover_whole_tables(spark):
    documents = {r.doc_id: r.text for r in D.table(spark, SF, "documents").collect()}
    assert catalogue.press_chunks(spark, SF).count() == sum(len(release(t)) for t in documents.values())
    assert catalogue.paper_chunks(spark, SF).count() == sum(len(paper(t)) for t in documents.values())
    assert catalogue.transcript_chunks(spark, SF).count() == sum(len(transcript(r.transcript)) for r in D.calls(spark, SF).collect())


def test_table_functions_of_sql(spark, texts):
    """The packers by name, over TABLE arguments."""
    chunking.register(spark)
    some = texts[-40:]
    pages = spark.createDataFrame([("t", k, t) for k, t in enumerate(some)], "paper_title string, page_num int, text string")
    chunking.page_paragraphs(pages).createOrReplaceTempView("page_paragraphs")
    got = spark.sql("SELECT page_num, count(*) AS n FROM pack_pages(TABLE(page_paragraphs)) GROUP BY page_num").collect()
    assert {r.page_num: r.n for r in got} == {k: len(paper(t)) for k, t in enumerate(some) if paper(t)}
    calls = spark.createDataFrame([(str(k), "d", t) for k, t in enumerate(some)], "symbol string, earnings_date string, transcript string")
    chunking.transcript_parts(calls).createOrReplaceTempView("transcript_parts")
    got = spark.sql("SELECT symbol, text FROM pack_turns(TABLE(transcript_parts)) ORDER BY symbol, position").collect()
    want = {str(k): [t for _, _, t in transcript(x)] for k, x in enumerate(some)}
    assert [(r.symbol, r.text) for r in got] == [(k, t) for k in sorted(want) for t in want[k]]


def test_packing_by_hand():
    import numpy as np
    import pyarrow as pa

    unit, last, first, text = chunking.pack(np.array([0, 0, 0, 1, 1, 2]), pa.array(["aa", "bb", "c" * 10, "", "dd", "x" * 3]), 5, 20, 3)
    assert list(zip(unit.tolist(), last.tolist(), first.tolist(), text.to_pylist())) == [(0, 1, 0, "aa bb"), (0, 2, 2, "c" * 10), (2, 5, 5, "xxx")]
    assert chunking.pack(np.array([], int), pa.array([], pa.string()), 5, 20, 3)[3].to_pylist() == []
    assert chunking.pack_paragraphs(np.array([0]), pa.array(["x"]), 2, 5, 9)[1].to_pylist() == []
