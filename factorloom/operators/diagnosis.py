"""Diagnoses of failed features by a model, with rules in its place where it fails.

One pass over the rows: a prompt is a column, a task asks the model for each of its rows, and the reply is taken apart
by column expressions; rows whose model failed `tries` times, or gave a blank reply, get the rule's diagnosis in the
same plan. No row is joined back, so repeated features keep a row each.

Defined cases: null metrics read n/a in the prompt; null or empty failures read none; a reply without labelled lines is
its own root cause, by its first 100 characters, without fix; no rows, no calls; without a model every row has the
rule's diagnosis and no task runs Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import text as T
from factorloom.operators import gates

Model = Callable[[str], str]
# fixed values: the labels of a reply's lines
LABELS = {"root_cause": "根因", "fix": "修复", "avoid": "避免"}
HINTS = {
    "uniform": "Zeros are spread evenly over sectors: most texts say nothing of the subject. Change the definition or the scope, not the scale.",
    "concentrated": "Zeros are concentrated in a few sectors, whose wording the instruction misses. Add examples of these; leave the scale alone.",
    "systemic_sparse": "Zeros are many in all sectors alike: the subject is rare as a whole.",
}
OUTPUT = "feature string, mode string, failures array<string>, reply string, error string"


def prompt(instruction: Column, theory: Column | None = None) -> Column:
    """The request for one result: its metrics, sectors and years with most and fewest zeros, what kind of zeros these
    are, the failed checks, and how to answer."""
    said = lambda c, form: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c) * 100 if "%%" in form else F.col(c))), F.lit("n/a"))
    keys = lambda c, **how: F.coalesce(F.nullif(F.array_join(gates.worst(c, **how), ", "), F.lit("")), F.lit("n/a"))
    hint = F.coalesce(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[gates.zero_type()], F.lit("The kind of zeros is unknown; judge it by the sectors."))
    failed = F.coalesce(F.nullif(F.array_join(F.transform("failures", lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("")), F.lit("none"))
    lines = [
        F.concat(F.lit("A text feature failed its checks. Name: "), F.coalesce("feature", F.lit("n/a"))), F.concat(F.lit("Instruction: "), F.coalesce(F.substring(instruction, 1, 300), F.lit("n/a"))),
        F.concat(F.lit("IC "), said("ic_mean", "%+.4f"), F.lit(", t "), said("t_stat", "%+.3f"), F.lit(", zeros "), said("zero_ratio", "%.1f%%"), F.lit(", direction "), said("direction_consistency", "%.0f%%")),
        F.concat(F.lit("Most zeros by sector: "), keys("zero_by_sector"), F.lit("; fewest: "), keys("zero_by_sector", ascending=True), F.lit("; by year: "), keys("zero_by_year")), hint,
        F.concat(F.lit("Failed checks:\n"), failed), *([] if theory is None else [F.concat(F.lit("Literature:\n"), F.nullif(theory, F.lit("")))]),
        F.lit("Answer in three lines, no more: " + "; ".join(f"{v}: <{k}>" for k, v in LABELS.items())),
    ]
    return F.concat_ws("\n\n", *lines)


def asked(rows: DataFrame, model: Callable[[], Model], tries: int, wait: float) -> DataFrame:
    """rows (feature, mode, failures, prompt) with the model's reply, or null and the last error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask = model()
        for b in batches:
            replies, errors = [], []
            for p in b["prompt"]:
                reply = error = None
                for attempt in range(tries):
                    try:
                        reply, error = ask(p), None
                        break
                    except Exception as e:  # a model's failure costs this row its reply only
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**attempt)
                replies.append(reply)
                errors.append(error)
            yield b[["feature", "mode", "failures"]].assign(reply=replies, error=errors)

    return rows.mapInPandas(run, OUTPUT)


def diagnosed(results: DataFrame, mode: Column, model: Callable[[], Model] | None = None, instruction: Column | None = None, theory: Column | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """feature, mode, root_cause, fix, avoid, source ('model' or 'rule'), error of results with failures.

    `model()` is called once a task and gives a function of a prompt; its replies cost one call a row.
    """
    rows = results.select("feature", mode.alias("mode"), "failures", prompt(F.lit(None).cast("string") if instruction is None else instruction, theory).alias("prompt"))
    if model is None:
        rows = rows.select("feature", "mode", "failures", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"))
    else:
        rows = asked(rows, model, tries, wait)
    reply, rule = T.stripped(F.col("reply")), gates.rule_diagnosis(F.col("mode"))
    told = F.coalesce(reply != "", F.lit(False))
    causes = F.coalesce(F.nullif(F.array_join("failures", "; "), F.lit("")), F.lit("none"))
    of = {
        "root_cause": (T.labelled(reply, LABELS["root_cause"]), F.concat(rule["root_cause"], F.lit("; failed checks: "), causes)),
        "fix": (T.labelled(reply, LABELS["fix"], F.lit("")), rule["fix"]), "avoid": (T.labelled(reply, LABELS["avoid"], F.lit("")), F.lit("")),
    }
    return rows.select("feature", "mode", *[F.when(told, a).otherwise(b).alias(k) for k, (a, b) in of.items()], F.when(told, "model").otherwise("rule").alias("source"), "error")
