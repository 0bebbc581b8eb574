"""Text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide sections, roles and noise.
QA_BOUNDARY = [
    r"(?i)^\s*questions?\s*(?:and|&)\s*answers?\s*$",
    r"(?i)^\s*q\s*&?\s*a\s*$",
    r"(?i)^\s*question[- ]and[- ]answer\s+session\s*$",
    r"(?i)we will now (?:begin|open|take|start).*(?:q(?:uestion)?[-\s]*&?[-\s]*a(?:nswer)?|question)",
    r"(?i)the operator will now.*(?:q(?:uestion)?[-\s]*&?[-\s]*a(?:nswer)?)",
    r"(?i)turn (?:the call|it) over.*(?:q(?:uestion)?[-\s]*&?[-\s]*a(?:nswer)?)",
]
QA_WORDS = ["question", "analyst", "q&a", "operator:", "please go ahead", "your question", "thank you, operator"]
ANALYST_PREFIX = r"(?i)^Q\s*[–\-]\s*"
ANALYST_FIRMS = r"(?i)\b(analyst|research|securities|capital|morgan|goldman|jpmorgan|barclays|citi|ubs|bofa|bank of america|deutsche|jefferies|wells|cowen|nomura|hsbc|credit suisse|evercore|piper|raymond|bernstein|mizuho)\b"
RELEASE_NOISE = r"(?i)^(EX-99\.1\s|Exhibit\s+99\.1|Table of Contents$|UNITED STATES SECURITIES|Washington,\s*D\.C\.|FORM\s+8-K|CURRENT REPORT|Pursuant to Section|Commission File Number|IRS Employer|CHECK THE APPROPRIATE|\(State or other)"
FILE_NAME = r"(?i)\.(htm|pdf|htm[l]?)\b"
PAPER_NOISE = r"(?i)^(arXiv:|https?://|doi:|www\.|©|\d+\s*$|References$|Abstract$|Introduction$|Conclusion)"
SPEAKER_TURN = r"(?m)^([A-Z][A-Za-z\s,\-\.]{2,60}):[ \t]*\n?"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
RETRYABLE_NAMES = ["Timeout", "ConnectionError", "RemoteDisconnected", "ReadTimeout", "ConnectTimeout", "RateLimitError", "ServiceUnavailableError", "APITimeoutError", "APIConnectionError"]
RETRYABLE_WORDS = ["timeout", "rate limit", "too many requests", "service unavailable", "connection reset", "connection refused", "try again"]
SECRET_KEYS = ["api_key", "password", "token"]

# Sizes in characters.
MAX_CHUNK, MIN_CHUNK, DROP_CHUNK = 1600, 100, 30
PAPER_MAX, PAPER_MIN, PAPER_DROP = 1200, 150, 50
RELEASE_HEAD, RELEASE_LEAST = 20_000, 500


def lines(text: Column) -> Column:
    """Lines as Python's splitlines makes them; none for an empty text."""
    parts = F.split(text, LINE_BREAK, -1)
    ended = F.element_at(parts, -1) == ""
    return F.when(ended, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (stripped(text) == "")


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def qa_line(text: Column) -> Column:
    """0-based line at which questions and answers start; null if none does."""
    found = F.array_position(F.transform(lines(text), lambda x: any_match(x, QA_BOUNDARY)), True)
    return F.when(~is_blank(text) & (found > 0), (found - 1).cast("int"))


def prepared_part(text: Column) -> Column:
    at = qa_line(text)
    cut = stripped(F.array_join(F.slice(lines(text), 1, F.coalesce(at, F.lit(0))), "\n"))
    return F.when(is_blank(text), "").when(at.isNull(), stripped(text)).otherwise(cut)


def qa_part(text: Column) -> Column:
    at = qa_line(text)
    return F.when(is_blank(text) | at.isNull(), "").otherwise(stripped(F.array_join(F.slice(lines(text), at + 1, F.greatest(F.size(lines(text)), F.lit(1))), "\n")))


def section_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in QA_WORDS]), "qa").otherwise("prepared")


def speaker_role(speaker: Column) -> Column:
    return (
        F.when(speaker.isNull() | (speaker == ""), "unknown").when(speaker.rlike(ANALYST_PREFIX), "analyst").when(F.lower(speaker).contains("operator"), "operator")
        .when(speaker.rlike(ANALYST_FIRMS), "analyst").otherwise("mgmt")
    )


def release_noise(line: Column) -> Column:
    """Whether a press release line is noise: blank, boilerplate, file names, few letters, or rows of figures."""
    s = stripped(line)
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    figures = F.length(F.regexp_replace(s, r"[^$,]", ""))
    return (
        (s == "") | ((F.length(s) < 120) & s.rlike(RELEASE_NOISE)) | ((F.length(s) < 200) & s.rlike(FILE_NAME))
        | ((F.length(s) > 20) & (letters / F.nullif(F.length(s), F.lit(0)) < 0.25)) | (s.rlike(r"^\s*[$\d(\-]") & (figures > 3))
    )


def release_admitted(text: Column) -> Column:
    return ~is_blank(text) & (F.length(text) >= RELEASE_LEAST)


def release_lines(text: Column) -> Column:
    """The lines of a release's head that are not noise, stripped."""
    return F.transform(F.filter(lines(F.substring(text, 1, RELEASE_HEAD)), lambda x: ~release_noise(x)), stripped)


def paper_text(text: Column) -> Column:
    """Page text with hyphenation undone, soft line breaks as spaces, and runs of spaces as one."""
    joined = F.regexp_replace(text, r"-\n([a-z])", "$1")
    joined = F.regexp_replace(joined, r"(?<!\n)\n(?!\n)(?![A-Z\d])", " ")
    return stripped(F.regexp_replace(joined, r" {2,}", " "))


def paper_noise(line: Column) -> Column:
    return stripped(line).rlike(PAPER_NOISE)


def cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def score_lines(text: Column, low: float, high: float) -> Column:
    """Map from index to clipped score for lines 'index: score'; a later line wins."""
    pattern = r"^\s*(\d+)\s*:\s*([-+]?\d+(?:\.\d+)?)\s*$"
    good = F.filter(lines(text), lambda x: x.rlike(pattern))
    pairs = F.transform(good, lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("index"), F.least(F.greatest(F.regexp_extract(x, pattern, 2).cast("double"), F.lit(float(low))), F.lit(float(high))).alias("score")))
    add = lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["index"]), F.map_from_arrays(F.array(p["index"]), F.array(p["score"])))
    return F.aggregate(pairs, F.create_map().cast("map<int,double>"), add)


def first_number(text: Column, low: float, high: float) -> Column:
    """The first number in a text, clipped; null if there is none."""
    found = F.regexp_extract(text, r"([-+]?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", F.least(F.greatest(found.try_cast("double"), F.lit(float(low))), F.lit(float(high))))


def feature_name(name: Column) -> Column:
    """A lower-case identifier; names that are one already stay."""
    cleaned = F.btrim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(name.rlike(r"^[a-z][a-z0-9_]+$"), name).otherwise(cleaned)


def distinct_name(name: Column, taken: Column) -> Column:
    return F.when(F.array_contains(taken, name), F.concat(name, F.lit("_v2"))).otherwise(name)


def direction(said: Column) -> Column:
    return F.when(said.isin("+", "-"), said).when(F.lower(said.cast("string")).isin("positive", "up", "1", "+1"), "+").otherwise("-")


def json_in(text: Column) -> Column:
    """The JSON object in a reply: code fence off, from the first brace on."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def labelled(text: Column, label: str, default: Column | None = None) -> Column:
    """What follows `label:` at the start of a line; else the default, or the text's first 100 characters."""
    found = F.filter(lines(text), lambda x: F.startswith(stripped(x), F.lit(f"{label}:")))
    value = stripped(F.substring(stripped(F.get(found, 0)), len(label) + 2, 100_000))
    return F.coalesce(value, default if default is not None else F.substring(text, 1, 100))


def token_estimate(text: Column) -> Column:
    """1.5 tokens a CJK character and a quarter for each other one, cut to whole tokens."""
    cjk = F.regexp_count(text, F.lit(r"[一-鿿]"))
    return F.coalesce(F.floor(cjk * 1.5 + (F.length(text) - cjk) / 4.0).cast("int"), F.lit(0))


def truncated(text: Column, most: int) -> Column:
    """text, or its first part and a marker if it is over `most` tokens."""
    tokens = token_estimate(text)
    keep = F.floor(F.length(text) * (F.lit(float(most)) / F.nullif(tokens, F.lit(0))) * 0.9).cast("int")
    return F.when(text.isNull() | (F.lit(most) <= 0), "").when(tokens <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), keep), F.lit("\n\n[...truncated...]")))


def key_metrics(observation: Column) -> Column:
    """IC, t and zero ratio that an observation states, as 'IC=.. t=.. zr=..%'."""
    get = lambda p: F.nullif(F.regexp_extract(observation, p, 1), F.lit(""))
    parts = [("IC=", get(r"IC=([+-]?\d+\.\d+)"), ""), ("t=", get(r"t=([+-]?\d+\.\d+)"), ""), ("zr=", get(r"zero_ratio=(\d+\.?\d*)%?"), "%")]
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(a), v, F.lit(z))) for a, v, z in parts])), " ")


def base_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("_v2_v2"), F.lit("")), F.lit("_v2"), F.lit(""))


def sanitised(args: Column, most: int = 200) -> Column:
    """A string map without private keys, secrets masked and long values cut."""
    open_ = F.map_filter(args, lambda k, v: ~F.startswith(k, F.lit("_")))
    return F.transform_values(open_, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), "***").when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v))


def retryable(name: Column, message: Column) -> Column:
    """Whether an error may pass if tried again."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(name.isin(RETRYABLE_NAMES), F.lit(False)) | reduce(lambda a, b: a | b, [low.contains(w) for w in RETRYABLE_WORDS])


def summary(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def step_summary() -> Column:
    """One line for a trace step."""
    mark = F.when(F.col("tool_ok"), "✓").otherwise("✗")
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return F.concat_ws(
        " ", F.format_string("[Step%d|%s]", "step_id", "state"), F.when(present("tool_called"), F.concat("tool_called", mark)),
        F.when(F.coalesce("tool_latency_ms", F.lit(0.0)) != 0, F.concat(F.bround("tool_latency_ms", 0).cast("long").cast("string"), F.lit("ms"))), F.when(present("decision"), F.concat(F.lit("→"), "decision")),
        F.when(present("tool_error"), F.concat(F.lit("err="), F.substring("tool_error", 1, 60))),
    )


def episode_summary() -> Column:
    """Pipe-joined text of a memory record."""
    failed = F.col("outcome") == "FAIL"
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return F.concat_ws(
        " | ", F.concat(F.lit("Feature: "), "feature_name"), F.concat(F.lit("Definition: "), "definition"), F.concat(F.lit("Outcome: "), "outcome"),
        F.when(failed, F.concat(F.lit("Failures: "), F.array_join("failures", ", "))), F.when(failed & some("diagnosis_root_cause"), F.concat(F.lit("Root Cause: "), "diagnosis_root_cause")),
        F.when(failed & some("diagnosis_fix"), F.concat(F.lit("Fix: "), "diagnosis_fix")), F.when(~failed, F.format_string("IC=%+.4f t=%+.3f", "ic", "t_stat")),
    )
