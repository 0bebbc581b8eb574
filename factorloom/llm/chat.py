"""Chat formatting: schema fingerprints select declarative mappings from record layouts to canonical turns.

A layout is the set of nested field paths of a record, list members written [], with a type letter. Its fingerprint is
a hash of the sorted paths, and MAPPINGS says for each known layout where role, text and turns stand. Records are JSON
strings or the columns of a table; both go through the same fingerprints. Canonical turns (conv_id, turn, role, text)
become one formatted segment a turn, so that no conversation, however long, has to fit into one value:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

with \\ and <| in roles and texts, and newlines in roles, escaped reversibly. The loss mask covers assistant texts.

Defined cases: null text and null role are empty. Rows that repeat stay, ordered by turn, then role, then text. Rows
with null conv_id form one conversation. Records of an unknown layout, and those that aren't JSON or are nested too
deeply to read, are rows without a layout, which `unknown_layouts` counts. A lone surrogate in a JSON string is no
character and becomes U+FFFD. Additional columns of a table, whatever their names, don't change its layout: columns
conv_id, turn, role and text come first, then the layout that finds most of its fields, then a `record` of JSON.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of (role or role path, text path), or a list field with member paths."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None


#: Declared layouts: paths end in s (string or null), n (number) or b (boolean).
MAPPINGS = [
    Mapping("rows_by_turn", ("role:s", "text:s")),
    Mapping("prompt_completion", ("prompt:s", "completion:s"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt:s", "response:s"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("system:s", "prompt:s", "response:s"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question:s", "answer:s"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction:s", "output:s"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction:s", "input:s", "output:s"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("messages", ("messages[].role:s", "messages[].content:s"), each=("messages", "role", "content")),
    Mapping("message_parts", ("messages[].role:s", "messages[].content[].text:s", "messages[].content[].type:s"), each=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from:s", "conversations[].value:s"), each=("conversations", "from", "value")),
]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}
OWN_FIELDS = {re.split(r"[.\[:]", p)[0] for m in MAPPINGS for p in m.paths}


def paths_of(value: object, at: str = "") -> list[str]:
    """The nested field paths of a parsed record; ids and other fields outside OWN_FIELDS don't count."""
    if isinstance(value, dict):
        return [p for k, v in value.items() if at or k in OWN_FIELDS for p in paths_of(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [p for v in value for p in paths_of(v, f"{at}[]")]
    return [f"{at}:{'b' if isinstance(value, bool) else 'n' if isinstance(value, int | float) else 's'}"]


def paths_of_schema(schema: T.StructType) -> list[str]:
    """The same paths for a table's columns."""

    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{at}.{f.name}")]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{at}[]")
        return [f"{at}:{'b' if isinstance(kind, T.BooleanType) else 'n' if isinstance(kind, T.NumericType) else 's'}"]

    return [p for f in schema.fields if f.name in OWN_FIELDS for p in walk(f.dataType, f.name)]


def _said(value: object) -> str:
    if isinstance(value, list):
        return "".join(_said(x.get("text") if isinstance(x, dict) else x) for x in value)
    return "" if value is None else str(value).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    if mapping.each:
        field, role, text = mapping.each
        return [(ROLES.get(_said(x.get(role)), _said(x.get(role))), _said(x.get(text))) for x in record.get(field) or [] if isinstance(x, dict)]
    return [(role, "\n".join(x for x in (_said(record.get(f)) for f in path.split("+")) if x)) for role, path in mapping.turns]


def read_record(text: str | None) -> tuple[Mapping | None, list[tuple[str, str]]]:
    """The mapping that a JSON record's fingerprint selects, if any, and the record's turns."""
    try:
        record = json.loads(text or "")
        mapping = BY_FINGERPRINT.get(fingerprint(paths_of(record))) if isinstance(record, dict) else None
        return mapping, turns_of(record, mapping) if mapping else []
    except (ValueError, RecursionError):
        return None, []


def turns_of_json(records: DataFrame) -> DataFrame:
    """Canonical turns of records (conv_id, record: JSON), each mapped by its own fingerprint; layout names it, or is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv_id, text in zip(b.column("conv_id").to_pylist(), b.column("record").to_pylist()):
                mapping, said = read_record(text)
                rows += [(conv_id, k, role, words, mapping.name) for k, (role, words) in enumerate(said)] or [(conv_id, None, None, None, mapping and mapping.name)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record")).mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


def unknown_layouts(records: DataFrame) -> DataFrame:
    """How many JSON records no mapping fits."""
    return turns_of_json(records).filter("layout is null").agg(F.count(F.lit(1)).alias("records"))


def layout_of(table: DataFrame) -> Mapping | None:
    """The mapping of a table's columns: rows by turn if conv_id, turn, role and text are all there; else the one with
    exactly these fields; else, as other columns may clash with fields of other layouts, the one that finds most."""
    paths = set(paths_of_schema(table.schema))
    fits = [m for m in MAPPINGS if set(m.paths) <= paths and (m.name != "rows_by_turn" or "turn" in table.columns)]
    return min(fits, key=lambda m: (m.name != "rows_by_turn", -len(m.paths)), default=None)


def canonical_turns(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, layout of a table whose columns have a known layout, or else a `record` column of JSON.

    A record of no known layout is a row without layout, turn, role and text; one of no turns has no rows."""
    mapping = layout_of(table)
    if mapping is not None and mapping.name == "rows_by_turn":
        said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.lit(mapping.name).alias("layout"))
    if mapping is not None:
        fields = sorted({re.split(r"[.\[:]", p)[0] for p in mapping.paths})
        table = table.select("conv_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    elif not {"conv_id", "record"} <= set(table.columns):
        raise ValueError(f"no mapping has this layout: {sorted(paths_of_schema(table.schema))}")
    return turns_of_json(table).filter("layout is null or role is not null")


def formatted(turns: DataFrame) -> DataFrame:
    """turns with `segment`, the formatted turn, and `loss`, whether its text is under the loss mask. Rows that stand for
    a record of unknown layout have none and are left out."""
    turns = turns.filter("role is not null")
    safe = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    role = F.replace(F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")), F.lit("\n"), F.lit("\\n"))
    return turns.withColumn("segment", F.concat(F.lit(START), role, F.lit("\n"), safe, F.lit(END + "\n"))).withColumn("loss", F.col("role") == "assistant")


SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def parsed(segment: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in SEGMENT.finditer(segment)]


RESULT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """A row per conversation, read back from formatted segments (conv_id, turn, segment).

    Segments stream through each task in order, with running digests only, so a conversation may have any length.
    """
    small_batches(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, began, state = None, False, None

        def row() -> dict:
            return {"conv_id": open_id, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        for b in batches:
            done = []
            for conv_id, segment in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist()):
                if not began or conv_id != open_id:
                    if began:
                        done.append(row())
                    open_id, began, state = conv_id, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(segment)
            yield pa.RecordBatch.from_pylist(done, RESULT)
        yield pa.RecordBatch.from_pylist([row()] if began else [], RESULT)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "segment").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(table: DataFrame) -> DataFrame:
    return digests(formatted(canonical_turns(table)))
