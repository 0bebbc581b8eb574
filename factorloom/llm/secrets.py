"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are assignments of secrets, access identifiers and hex runs. Weak candidates (identifiers by name, long
mixed strings, endpoints) are reported only where complementary parts co-occur: the parts of a document are points on
a line, and a range window of SCOPE code points around each one, which is an interval join that emits no pairs, counts
the identifiers, secrets and endpoints in its scope. A weak identifier needs a secret, a weak secret an identifier,
and an endpoint both. Weak candidates that overlap base spans are left out. Each reported identifier is linked with the
nearest reported secret in its scope, and the nearest endpoint if there is one, the earlier of two as near.

Positions come from the text's pieces between matches: a match starts after all earlier pieces and matches.

Defined cases: null and empty text have no spans, and empty digests. Repeated rows are scanned each for itself. Only
doc_id and text are read. Texts of any length are scanned whole; no text enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import numbered, stored

VALUE = r"[A-Za-z0-9+/_.=-]+"
#: kind: (pattern, group whose length counts, least length, part). The order is the order of kinds in digests.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(""" + VALUE + ")", 2, 12, "secret"),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, "identifier"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "secret"),
    "weak_id": (r"""((?i:access_?key_?id|client_?id|user_?name|account_?id|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, "identifier"),
    "weak_key": (r"[A-Za-z0-9+/]{32,}", 0, 32, "secret"),
    "endpoint": (r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9_.:/@?&=%-]+", 0, 8, "endpoint"),
}
BASE = ("assign", "access", "hex")
SCOPE = 300


def _candidates(text: Column, kind: str) -> Column:
    """Array of (kind, order, gap, size, kept): each match's distance from the one before, its length, whether it counts."""
    pattern, group, least, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("hit"), counted.alias("value"))
    order = list(KINDS).index(kind)
    rows = F.transform(both, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.length(x["piece"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["value"]) >= least).alias("kept")))
    # the last piece has no match after it
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,order:int,gap:int,size:int,kept:boolean>>"))


def with_ids(docs: DataFrame) -> DataFrame:
    """row_id, doc_id and text of docs; null text is empty."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def linked_spans(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, kind, order, start, end, part, secret, endpoint: all reported spans of rows (row_id, doc_id, text),
    and of identifiers the spans (start, end) they are linked with; a document without any span has rows of null kind."""
    found = rows.select("row_id", "doc_id", F.posexplode_outer(F.concat(*[_candidates(F.col("text"), k) for k in KINDS])).alias("n", "m"))
    so_far = Window.partitionBy("row_id", "order").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    flat = found.select("row_id", "doc_id", "n", "m.*").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    # a match that fails still stands for its document, as a row of null kind
    flat = flat.withColumn("kind", F.when(F.col("kept"), F.col("kind"))).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind").isin(*BASE)
    part = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])])[F.col("kind")]
    line = Window.partitionBy("row_id").orderBy("start", "order", "end")
    backward = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("order"), F.desc("end"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (line, backward))
    overlaps = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    clear = flat.withColumn("overlaps", overlaps).filter(F.col("kind").isNull() | base | ~F.col("overlaps")).withColumn("part", part)
    scope = Window.partitionBy("row_id").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    near = lambda p: F.sum(F.when(F.col("part") == p, 1).otherwise(0)).over(scope) > 0
    linked = clear.withColumn("identifiers", near("identifier")).withColumn("secrets", near("secret"))
    complete = (
        F.when(F.col("kind").isNull() | base, F.lit(True)).when(F.col("part") == "identifier", F.col("secrets")).when(F.col("part") == "secret", F.col("identifiers"))
        .otherwise(F.col("identifiers") & F.col("secrets"))
    )
    # a weak candidate that lacks partners still stands for its document, as a row of null kind
    told = linked.withColumn("kind", F.when(complete, F.col("kind")))

    def nearest(p: str) -> Column:
        here = F.when(F.col("kind").isNotNull() & (F.col("part") == p), F.struct("start", "end"))
        last, first = F.last(here, ignorenulls=True).over(before), F.last(here, ignorenulls=True).over(after)
        back, forth = F.col("start") - last["start"], first["start"] - F.col("start")
        return F.when((back <= SCOPE) & (F.coalesce(forth, back) >= back), last).when(forth <= SCOPE, first).when(back <= SCOPE, last)

    identifies = F.col("kind").isNotNull() & (F.col("part") == "identifier")
    return told.select("row_id", "doc_id", "kind", "order", "start", "end", "part", *[F.when(identifies, nearest(p)).alias(p) for p in ("secret", "endpoint")])


def secret_digests(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, credentials (start-secret or
    start-secret-endpoint of each linked identifier, by their starts)."""
    spans = linked_spans(with_ids(docs)).withColumn("span", F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("said")))
    listed = lambda condition: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.col("span")))), lambda x: x["said"]), ",")
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(f"n_{k}") for k in BASE]
    linked = F.when(F.col("secret").isNotNull(), F.struct("start", F.concat_ws("-", "start", "secret.start", "endpoint.start").alias("said")))
    credentials = F.array_join(F.transform(F.array_sort(F.collect_list(linked)), lambda x: x["said"]), ",")
    grouped = spans.groupBy("row_id", "doc_id").agg(*counts, F.sha2(listed(F.col("kind").isin(*BASE)), 256).alias("base_sha256"), listed(F.col("kind").isNotNull()).alias("spans"), credentials.alias("credentials"))
    return grouped.drop("row_id")


def masked(docs: DataFrame, mask: str, broadcast: int = 200_000) -> DataFrame:
    """docs with each reported span of text replaced by `mask`, overlapping spans by one, and n_chars, if present, new."""
    rows = numbered(docs)  # spans and texts meet by these ids
    texts = rows.select("row_id", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    spans = linked_spans(texts).filter("kind is not null").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    spans = stored(spans.withColumnRenamed("row_id", "__spanned"), "spans")
    side = F.broadcast(spans) if spans.count() <= broadcast else spans  # beyond that the texts are shuffled
    both = rows.join(side, F.col("row_id") == F.col("__spanned"), "left").select("doc.*", "__spans")
    text = F.col("text")

    def add(state: Column, s: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(F.concat(piece, F.lit(mask)))).alias("out"))
        inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("__spans", start, add, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))
    out = both.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(done))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _kind_sql(kind: str) -> str:
    pattern, group, least, part = KINDS[kind]
    p = pattern.replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, {list(KINDS).index(kind)} AS ord, '{part}' AS part, unnest(list_transform(string_split_regex(x, '{p}'), lambda s: length(s))[:-2]) AS gap,
  unnest(list_transform(regexp_extract_all(x, '{p}', 0), lambda s: length(s))) AS size, unnest(list_transform(regexp_extract_all(x, '{p}', {group}), lambda s: length(s) >= {least})) AS kept,
  unnest(range(len(regexp_extract_all(x, '{p}', 0)))) AS n FROM d WHERE regexp_matches(x, '{p}')"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(k) for k in KINDS)}),
e AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY rid, ord ORDER BY n) AS BIGINT) AS stop FROM m),
f AS (SELECT rid, kind, ord, part, stop - size AS start, stop, ord < 3 AS base FROM e WHERE kept),
o AS (SELECT *, coalesce(max(CASE WHEN base THEN stop END) OVER (PARTITION BY rid ORDER BY start, ord, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false)
  OR coalesce(min(CASE WHEN base THEN start END) OVER (PARTITION BY rid ORDER BY start, ord, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < stop, false) AS hidden FROM f),
s AS (SELECT *, sum(CASE WHEN part = 'identifier' THEN 1 ELSE 0 END) OVER w > 0 AS ids, sum(CASE WHEN part = 'secret' THEN 1 ELSE 0 END) OVER w > 0 AS keys FROM o WHERE base OR NOT hidden
  WINDOW w AS (PARTITION BY rid ORDER BY start RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING)),
q AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM s WHERE base OR CASE part WHEN 'identifier' THEN keys WHEN 'secret' THEN ids ELSE ids AND keys END),
n AS (SELECT *, {", ".join(f"start - last_value(CASE WHEN part = '{p}' THEN start END IGNORE NULLS) OVER b AS {p}_back, first_value(CASE WHEN part = '{p}' THEN start END IGNORE NULLS) OVER f - start AS {p}_forth" for p in ("secret", "endpoint"))} FROM q
  WINDOW b AS (PARTITION BY rid ORDER BY start, ord, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY rid ORDER BY start, ord, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, {", ".join(f"CASE WHEN least({p}_back, {p}_forth) > {SCOPE} THEN NULL WHEN {p}_back IS NULL OR {p}_forth < {p}_back THEN start + {p}_forth ELSE start - {p}_back END AS {p}" for p in ("secret", "endpoint"))} FROM n)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, ord) FILTER (base), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, ord), '') AS spans,
  coalesce(string_agg(concat_ws('-', start, secret, endpoint), ',' ORDER BY start) FILTER (part = 'identifier' AND secret IS NOT NULL), '') AS credentials
FROM d LEFT JOIN r USING (rid) GROUP BY rid
"""
