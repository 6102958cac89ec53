"""Tool-call linking for chat formatting, with DataFrame functions only.

Calls and results are joined by conversation and call id, calls are put in an order in which a call
comes after the one whose result it uses, arguments are checked against a schema of each tool, and
each call is written as canonical JSON: sorted keys, no blanks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import table
from ebbtide.session import materialize

#: Tool -> argument -> (type, required, least, greatest).
Schemas = dict[str, dict[str, tuple[str, bool, float | None, float | None]]]

_TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<.*",
    "object": r"^OBJECT<.*",
}


def _errors(name, parsed, schemas: Schemas):
    """Sorted texts of what is wrong with the arguments; empty if they are valid."""
    out = F.array(F.lit("unknown tool"))
    for tool, arguments in schemas.items():
        found = []
        for key, (kind, required, least, greatest) in arguments.items():
            value = F.variant_get(parsed, f"$['{key}']", "variant")
            typed = F.schema_of_variant(value).rlike(_TYPES[kind])
            if required:
                found.append(F.when(value.isNull(), f"missing {key}"))
            found.append(F.when(value.isNotNull() & ~typed, f"type {key}"))
            number = F.try_variant_get(parsed, f"$['{key}']", "double")
            if least is not None:
                found.append(F.when(typed & (number < least), f"range {key}"))
            if greatest is not None:
                found.append(F.when(typed & (number > greatest), f"range {key}"))
        known = F.array(*[F.lit(k) for k in arguments])
        other = F.transform(
            F.array_except(F.json_object_keys(F.to_json(parsed)), known), lambda k: F.concat(F.lit("unknown "), k)
        )
        texts = F.concat(F.array_compact(F.array(*found)), other)
        out = F.when(name == tool, texts).otherwise(out)
    not_an_object = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(not_an_object, F.array(F.lit("not a JSON object"))).otherwise(F.array_sort(F.array_distinct(out)))


def parsed_whole(text):
    """The text as a variant, null if it is not one JSON value and nothing else.

    The parser stops behind the first value. Inside brackets, text behind it is an error unless it closes
    them, and no text closes both a list's and an object's.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))) for a, b in (("[", "]"), ('{"a":', "}"))]
    return F.when(inside[0].isNotNull() & inside[1].isNotNull(), F.try_parse_json(text))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): calls before it in its chain of parents, null on a cycle.

    Pointer jumping: each round doubles the way that is known, so long chains take few rounds. The
    number of calls not yet at their root falls each round until only those on cycles are left.
    """
    own = calls.select("conv_id", "call_id", "parent_id")
    exists = own.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    match = own["conv_id"].eqNullSafe(exists["_c"]) & (own["parent_id"] == exists["_p"])
    state = materialize(
        own.join(exists, match, "left").select(
            "conv_id", "call_id", F.col("_p").alias("up"), F.col("_p").isNotNull().cast("long").alias("way")
        ),
        "call-depths",
    )
    open_before = None
    while (left := state.where("up IS NOT NULL").count()) and left != open_before:
        open_before = left
        jump = state.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        match = state["conv_id"].eqNullSafe(jump["_c"]) & (state["up"] == jump["_p"])
        state = materialize(
            state.join(jump, match, "left").select(
                "conv_id", "call_id", F.col("_up").alias("up"), (F.col("way") + F.coalesce("_way", F.lit(0))).alias("way")
            ),
            "call-depths",
        )
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("way")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call id or orphaned result id: conv_id, call_id, seq, depth, status, errors, json.

    `calls` has conv_id, call_id, parent_id, seq, name, arguments (JSON text); `results` has
    conv_id, call_id, seq, content. In a conversation, depth and then seq order the calls. Of calls
    or results that share an id the first by seq counts (n_calls and n_results tell how many there
    were); a null call_id links with nothing and such rows are left out. status is the first that
    holds of: orphan (a result without a call), cycle, invalid, pending (no result), ok. Null seqs are
    smallest. Canonical JSON has sorted keys and leaves out none; numbers are written as the parser reads
    them (1.50 as 1.5, 1e2 as 100.0, integers of more than 38 digits as doubles). Arguments that are no
    JSON object, have text behind it, repeat a key, or are larger than a variant may be are "not a JSON
    object" and written as a string. Empty tables give no rows; other columns are not read.
    """
    key = ["conv_id", "call_id"]
    known = calls.where("call_id IS NOT NULL")
    first = known.groupBy(*key).agg(
        F.min(F.struct("seq", "name", "arguments", "parent_id")).alias("c"), F.count(F.lit(1)).alias("n_calls")
    )
    first = materialize(first.select(*key, "c.*", "n_calls"), "calls")
    answers = (
        results.where("call_id IS NOT NULL")
        .groupBy(*key)
        .agg(F.min(F.struct("seq", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
        .select(*[F.col(c).alias(f"_r_{c}") for c in key], F.col("r.content").alias("content"), "n_results")
    )
    order = depths(first).select(*[F.col(c).alias(f"_d_{c}") for c in key], "depth")
    on = lambda left, right, p: [left[c].eqNullSafe(right[f"{p}{c}"]) for c in key]
    ordered = first.join(order, on(first, order, "_d_"))
    rows = ordered.join(answers, on(ordered, answers, "_r_"), "full")
    rows = rows.select(
        *[F.coalesce(ordered[c], F.col(f"_r_{c}")).alias(c) for c in key],
        "seq", "depth", "name", "arguments", "parent_id", "content",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        parsed_whole(F.col("arguments")).alias("parsed"),
    )
    orphan = F.col("n_calls") == 0
    errors = F.when(~orphan, _errors(F.col("name"), F.col("parsed"), schemas)).otherwise(F.array().cast("array<string>"))
    tail = F.to_json(
        F.struct("call_id", "name", F.col("parent_id").alias("parent"), F.col("content").alias("result")),
        {"ignoreNullFields": "false"},
    )
    quoted = F.to_json(F.struct(F.col("arguments").alias("a")), {"ignoreNullFields": "false"})
    quoted = quoted.substr(F.lit(6), F.length(quoted) - 6)  # of {"a":"..."}
    canonical = F.coalesce(F.to_json("parsed"), quoted)
    return rows.withColumn("errors", errors).select(
        *key, "seq", "depth", "n_calls", "n_results",
        F.when(orphan, "orphan").when(F.col("depth").isNull(), "cycle").when(F.size("errors") > 0, "invalid")
        .when(F.col("n_results") == 0, "pending").otherwise("ok").alias("status"),
        F.array_join("errors", "; ").alias("errors"),
        F.concat(F.lit('{"arguments":'), canonical, F.lit(","), tail.substr(F.lit(2), F.length(tail))).alias("json"),
    )


SCHEMAS: Schemas = {
    "search": {"query": ("string", True, None, None), "limit": ("integer", True, 1, 300), "exact": ("boolean", False, None, None)},
    "lookup": {"query": ("string", True, None, None), "limit": ("integer", True, 1, None)},
    "summarise": {"query": ("string", True, None, None), "limit": ("integer", True, 1, None), "exact": ("boolean", False, None, None), "style": ("string", True, None, None)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn calls a tool, and the assistant's
    turn behind it is the result. The tool follows from the length of the text; every second kind
    of text builds on the call two turns before."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    name_of = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    arguments = F.struct(
        text.alias("query"), n.alias("limit"),
        F.when(n % 3 != 1, n % 2 == 0).alias("exact"), F.when(n % 4 == 0, "short").alias("style"),
    )
    calls = turns.where("role = 'user'").select(
        "conv_id",
        name_of(F.col("turn")).alias("call_id"),
        F.when(n % 2 == 0, name_of(F.col("turn") - 2)).alias("parent_id"),
        F.col("turn").alias("seq"),
        F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("summarise")), (n % 3 + 1).cast("int")).alias("name"),
        F.to_json(arguments).alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", name_of(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content")
    )
    return calls, results


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, SCHEMAS)


OP10_SQL = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, coalesce(text, '') AS q, length(coalesce(text, '')) AS n,
         'call_' || conv_id || '_' || turn AS call_id,
         CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 'call_' || conv_id || '_' || (turn - 2) END AS parent_id
  FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
d AS (
  SELECT u.conv_id, u.call_id, CAST(0 AS BIGINT) AS depth FROM u
  WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE p.conv_id = u.conv_id AND p.call_id = u.parent_id)
  UNION ALL
  SELECT u.conv_id, u.call_id, d.depth + 1 FROM u JOIN d ON d.conv_id = u.conv_id AND d.call_id = u.parent_id),
e AS (
  SELECT u.*, depth, ['search', 'lookup', 'summarise'][n % 3 + 1] AS name,
    list_sort(list_filter([
      CASE WHEN n < 1 OR (n % 3 = 0 AND n > 300) THEN 'range limit' END,
      CASE WHEN n % 3 = 2 AND n % 4 <> 0 THEN 'missing style' END,
      CASE WHEN n % 3 <> 2 AND n % 4 = 0 THEN 'unknown style' END], lambda x: x IS NOT NULL)) AS errs
  FROM u JOIN d USING (conv_id, call_id)),
j AS (SELECT coalesce(e.conv_id, a.conv_id) AS conv_id, coalesce(e.call_id, a.call_id) AS call_id, e.turn AS seq, depth,
             e.call_id IS NOT NULL AS called, a.call_id IS NOT NULL AS answered, name, errs, q, n, parent_id, a.text AS content
      FROM e FULL JOIN a ON a.conv_id = e.conv_id AND a.call_id = e.call_id)
SELECT conv_id, call_id, seq, depth, CAST(called AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results,
  CASE WHEN NOT called THEN 'orphan' WHEN len(errs) > 0 THEN 'invalid' WHEN NOT answered THEN 'pending' ELSE 'ok' END AS status,
  coalesce(array_to_string(errs, '; '), '') AS errors,
  '{"arguments":' || CASE WHEN called THEN '{' || CASE WHEN n % 3 <> 1 THEN '"exact":' || (n % 2 = 0) || ',' ELSE '' END
    || '"limit":' || n || ',"query":' || to_json(q) || CASE WHEN n % 4 = 0 THEN ',"style":"short"' ELSE '' END || '}' ELSE 'null' END
  || ',"call_id":' || to_json(call_id) || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
  || ',"parent":' || coalesce(CAST(to_json(parent_id) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM j
"""
