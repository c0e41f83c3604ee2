"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions only. Calls and results are reduced to one row per identifier and hash-joined
on it. A call may wait for the result of another; how deep it stands is found by pointer doubling,
in a logarithmic number of joins, and depth, then turn, is a topological order. Arguments are parsed
as variants, checked against the tool's schema, and printed by the variant writer, which sorts keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.book import query
from trailmark.llm.common import table, word_count
from trailmark.llm.mixing import positions
from trailmark.session import cut_lineage

#: Argument types of a schema, and how Spark names values of them.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}

#: {tool: {argument: (type, whether it is required)}}
Schemas = dict[str, dict[str, tuple[str, bool]]]


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments (a variant) of a call, in order of the schema; empty if nothing."""
    found = F.when(arguments.isNull(), F.array(F.lit("arguments: not JSON"))).when(
        ~F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT")), F.array(F.lit("arguments: not an object"))
    )
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            # a name may hold quotes of one kind
            quote = "'" if '"' in field else '"'
            value = F.try_variant_get(arguments, f"$[{quote}{field}{quote}]", "variant")
            of = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
            if required:
                checks.append(F.when(~F.array_contains(keys, field), F.lit(f"{field}: missing")))
            checks.append(F.when(F.array_contains(keys, field) & ~of.isin(*TYPES[kind]), F.lit(f"{field}: not {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(": unknown")))
        known = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        found = found.when(name == tool, F.concat(known, F.array_sort(extra)))
    return found.otherwise(F.array(F.concat(F.lit("tool: unknown "), F.coalesce(name, F.lit("")))))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of unique calls: how many calls each waits for in turn; null on a circle.

    ``waits_for`` is null or the identifier of a call of the same conversation. Each round doubles
    the distance looked back; only calls that have not yet found their first one are joined.
    """
    key = ["conv_id", "call_id"]
    first = F.col("waits_for").isNull()
    found = cut_lineage(
        calls.select(
            *key,
            F.coalesce("waits_for", "call_id").alias("back"),
            F.when(first, 0).otherwise(1).cast("long").alias("steps"),
            first.alias("done"),
        )
    )
    reach, left, n = 1, found.filter("NOT done").count(), found.count()
    while left and reach <= 2 * n:
        there = found.select("conv_id", F.col("call_id").alias("back"), F.struct("back", "steps", "done").alias("on"))
        moved = found.filter("NOT done").join(there, ["conv_id", "back"])
        moved = moved.select(*key, F.col("on.back").alias("back"), (F.col("steps") + F.col("on.steps")).alias("steps"), F.col("on.done").alias("done"))
        found = cut_lineage(found.filter("done").unionByName(moved))
        reach, left = 2 * reach, found.filter("NOT done").count()
    return found.select(*key, F.when(F.col("done"), F.col("steps")).alias("depth"))


def _repeats(rows: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """The rows but for one that equals ``first`` (key..., and a struct ``least`` of the other columns) of their key.

    Equal rows are counted, so no key is gathered, and come out as often as they are more.
    """
    others = [c for c in rows.columns if c not in key]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).join(first, key)
    more = F.col("_n") - F.when(F.struct(*others).eqNullSafe(F.col("least")), 1).otherwise(0)
    return counted.withColumn("_n", more).filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(*rows.columns)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, messages: DataFrame | None = None) -> DataFrame:
    """One row per call, per result without a call, per repeated result and per message; every row given is in one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), waits_for (an identifier or
    null). ``results``: conv_id, call_id, turn, content. ``messages``, the other turns: conv_id,
    turn, role, content. Further columns are ignored. Returned: conv_id, position (from 0, an
    order in which every call comes after the one it waits for), call_id, turn, depth, name,
    status, problems, n_calls, n_results and line, the canonical JSON.

    Of repeated calls of one identifier the least (turn, name, arguments, waits_for) is linked, of results the
    least (turn, content); n_calls and n_results tell how many there were. The others are rows of status
    "repeated call" and "repeated result" at the same depth, with one for themselves. A call that waits for
    one that does not exist has that among its problems and depth 0; calls on a circle have no
    depth and come last. Rows without conv_id or call_id are linked to nothing and come out with status "no id",
    messages with status "message" and depth 0. Empty tables give an empty result.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "waits_for")
    results = results.select("conv_id", "call_id", "turn", "content")
    key = ["conv_id", "call_id"]
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = F.min(F.struct("turn", "name", "arguments", "waits_for"))
    unique = calls.filter(has_id).groupBy(*key).agg(first_call.alias("c"), F.count(F.lit(1)).alias("n_calls"))
    unique = cut_lineage(unique.select(*key, "c.*", "n_calls"))
    answers = results.filter(has_id).groupBy(*key)
    answers = answers.agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))

    known = unique.select("conv_id", F.col("call_id").alias("waits_for"), F.lit(True).alias("exists"))
    waiting = unique.join(known, ["conv_id", "waits_for"], "left")
    depth = depths(waiting.select(*key, F.when(F.col("exists"), F.col("waits_for")).alias("waits_for")))
    placed = waiting.join(depth, key).join(answers, key, "full_outer")
    status = (
        F.when(F.col("n_calls").isNull(), "no call")
        .when(F.col("n_results").isNull(), "no result")
        .when(F.col("r.turn") < F.col("turn"), "result before call")
        .otherwise("linked")
    )
    linked = placed.select(
        *key, F.coalesce("turn", "r.turn").alias("turn"), "depth", "name", "arguments", "waits_for", status.alias("status"),
        (F.col("waits_for").isNotNull() & F.col("exists").isNull()).alias("lost"), F.col("r.content").alias("content"), "n_calls", "n_results",
    )
    nameless = calls.filter(~has_id).select(
        *key, "turn", F.lit(0).cast("long").alias("depth"), "name", "arguments", "waits_for", F.lit("no id").alias("status"),
        F.lit(False).alias("lost"), F.lit(None).cast("string").alias("content"), F.lit(1).cast("long").alias("n_calls"), F.lit(None).cast("long").alias("n_results"),
    )
    unanswering = results.filter(~has_id).select(
        *key, "turn", F.lit("no id").alias("status"), F.lit(False).alias("lost"), "content", F.lit(1).cast("long").alias("n_results")
    )
    rows = linked.unionByName(nameless).unionByName(unanswering, allowMissingColumns=True)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    first = unique.select(*key, F.struct("turn", "name", "arguments", "waits_for").alias("least"))
    again = _repeats(calls.filter(has_id), first, key).join(known, ["conv_id", "waits_for"], "left").join(depth, key)
    lost = (F.col("waits_for").isNotNull() & F.col("exists").isNull()).alias("lost")
    again = again.select(*key, "turn", "depth", "name", "arguments", "waits_for", F.lit("repeated call").alias("status"), lost, one.alias("n_calls"))
    rows = rows.unionByName(again, allowMissingColumns=True)
    again = _repeats(results.filter(has_id), answers.select(*key, F.col("r").alias("least")), key).join(depth, key, "left")
    again = again.select(*key, "turn", "depth", "content", F.lit("repeated result").alias("status"), F.lit(False).alias("lost"), one.alias("n_results"))
    rows = rows.unionByName(again, allowMissingColumns=True).withColumn("role", F.lit(None).cast("string"))
    if messages is not None:
        said = messages.select("conv_id", "turn", "role", "content", zero.alias("depth"), F.lit("message").alias("status"), F.lit(False).alias("lost"))
        rows = rows.unionByName(said, allowMissingColumns=True)
    ordered = positions(rows, "conv_id", ["depth", "turn", "call_id", "status", "arguments", "content", "role", "name", "waits_for"])

    parsed = F.try_parse_json("arguments")
    lost = F.when(F.col("lost"), F.array(F.concat(F.lit("waits for unknown "), F.col("waits_for")))).otherwise(F.array().cast("array<string>"))
    is_call = F.col("n_calls").isNotNull()
    wrong = F.when(is_call, F.concat(problems(F.col("name"), F.col("_args"), schemas), lost)).otherwise(F.array().cast("array<string>"))
    shaped = ordered.withColumn("_args", parsed).withColumn("problems", wrong)
    # keys in alphabetical order; missing parts are left out
    line = F.to_json(
        F.struct(
            F.col("_args").alias("arguments"),
            F.when(F.col("_args").isNull(), F.col("arguments")).alias("arguments_text"),
            F.col("content").alias("content"),
            F.col("call_id").alias("id"),
            F.col("name").alias("name"),
            F.col("role").alias("role"),
            F.col("waits_for").alias("waits_for"),
        )
    )
    return shaped.select(
        "conv_id", F.col("pos").alias("position"), "call_id", "turn", "depth", "name", "status", "problems",
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), line.alias("line"),
    )


#: The tools that turns of ``conversations`` are read as calls of.
TOOLS: Schemas = {
    "search": {"limit": ("integer", True), "query": ("string", True)},
    "summarise": {"brief": ("boolean", False), "text": ("string", True)},
    "translate": {"text": ("string", True), "to": ("string", True)},
}


def calls_of(turns: DataFrame) -> DataFrame:
    """The user turns of ``conversations`` as calls: tool, arguments and dependence follow from the whole text."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text)
    at = lambda k: F.substring(digest, k, 1)
    name = F.when(at(1) < "6", "search").when(at(1) < "b", "translate").otherwise("summarise")
    words = word_count()
    query_ = text.alias("query")
    search = (
        F.when(at(2) == "0", F.to_json(F.struct(query_, words.cast("string").alias("limit"))))
        .when(at(2) == "1", F.to_json(F.struct(query_)))
        .otherwise(F.to_json(F.struct(query_, words.alias("limit"))))
    )
    translate = F.when(at(2) == "2", F.to_json(F.struct(F.lit("en").alias("to"), words.alias("size"), text.alias("text")))).otherwise(
        F.to_json(F.struct(F.lit("en").alias("to"), text.alias("text")))
    )
    summarise = F.when(at(2) == "3", F.lit('{"text": ')).otherwise(
        F.to_json(F.struct(text.alias("text"), (words > 50).alias("brief")))
    )
    arguments = F.when(name == "search", search).when(name == "translate", translate).otherwise(summarise)
    waits = F.when(at(3) >= "4", F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string")))
    return turns.filter("role = 'user'").select(
        "conv_id", F.concat(F.lit("call_"), F.col("turn").cast("string")).alias("call_id"), "turn",
        name.alias("name"), arguments.alias("arguments"), waits.alias("waits_for"),
    )


def results_of(turns: DataFrame) -> DataFrame:
    """The assistant turns as results of the turn before."""
    call = F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string"))
    return turns.filter("role = 'assistant'").select("conv_id", call.alias("call_id"), "turn", F.col("text").alias("content"))


def messages_of(turns: DataFrame) -> DataFrame:
    """The turns of all other roles, null too."""
    other = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    return turns.filter(other).select("conv_id", "turn", "role", F.col("text").alias("content"))


CALLS_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM conversations WHERE role = 'user'),
c AS (
  SELECT *, CASE WHEN h[1] < '6' THEN 'search' WHEN h[1] < 'b' THEN 'translate' ELSE 'summarise' END AS name,
    CASE WHEN h[3] >= '4' THEN 'call_' || (turn - 2) END AS waits_for FROM u),
a AS (
  SELECT *, name = 'summarise' AND h[2] = '3' AS broken,
    CASE name
      WHEN 'search' THEN CASE h[2]
        WHEN '0' THEN '{"limit":"' || n || '","query":' || to_json(t) || '}'
        WHEN '1' THEN '{"query":' || to_json(t) || '}'
        ELSE '{"limit":' || n || ',"query":' || to_json(t) || '}' END
      WHEN 'translate' THEN CASE h[2]
        WHEN '2' THEN '{"size":' || n || ',"text":' || to_json(t) || ',"to":"en"}'
        ELSE '{"text":' || to_json(t) || ',"to":"en"}' END
      ELSE '{"brief":' || (n > 50) || ',"text":' || to_json(t) || '}' END AS args,
    CASE WHEN name = 'search' AND h[2] = '0' THEN ['limit: not integer']
      WHEN name = 'search' AND h[2] = '1' THEN ['limit: missing']
      WHEN name = 'translate' AND h[2] = '2' THEN ['size: unknown']
      WHEN name = 'summarise' AND h[2] = '3' THEN ['arguments: not JSON'] ELSE []::VARCHAR[] END AS wrong
  FROM c),
e AS (
  SELECT a.*, p.call_id AS up FROM a LEFT JOIN a p ON p.conv_id = a.conv_id AND p.call_id = a.waits_for),
dep AS (
  SELECT conv_id, call_id, 0::BIGINT AS depth FROM e WHERE up IS NULL
  UNION ALL SELECT e.conv_id, e.call_id, dep.depth + 1 FROM e JOIN dep ON e.conv_id = dep.conv_id AND e.up = dep.call_id),
r AS (
  SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id,
    coalesce(e.turn, r.turn) AS turn, depth, name,
    CASE WHEN e.call_id IS NULL THEN 'no call' WHEN r.call_id IS NULL THEN 'no result' ELSE 'linked' END AS status,
    CASE WHEN waits_for IS NOT NULL AND up IS NULL THEN list_append(wrong, 'waits for unknown ' || waits_for)
      ELSE coalesce(wrong, []) END AS problems,
    (e.call_id IS NOT NULL)::BIGINT AS n_calls, (r.call_id IS NOT NULL)::BIGINT AS n_results,
    '{' || concat_ws(',',
      CASE WHEN broken THEN '"arguments_text":"{\"text\": "' WHEN args IS NOT NULL THEN '"arguments":' || args END,
      CASE WHEN r.text IS NOT NULL THEN '"content":' || to_json(r.text) END,
      '"id":"' || coalesce(e.call_id, r.call_id) || '"',
      CASE WHEN name IS NOT NULL THEN '"name":"' || name || '"' END,
      CASE WHEN waits_for IS NOT NULL THEN '"waits_for":"' || waits_for || '"' END) || '}' AS line
  FROM e JOIN dep USING (conv_id, call_id) FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
  UNION ALL
  SELECT conv_id, NULL, turn, 0, NULL, 'message', [], 0, 0,
    '{' || concat_ws(',', CASE WHEN text IS NOT NULL THEN '"content":' || to_json(text) END,
      CASE WHEN role IS NOT NULL THEN '"role":' || to_json(role) END) || '}'
  FROM conversations WHERE coalesce(role NOT IN ('user', 'assistant'), true))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn, call_id) - 1 AS position,
  call_id, turn, depth, name, status, array_to_string(problems, '; ') AS problems, n_calls, n_results, md5(line) AS line_md5
FROM j
"""


@query("op7_chat_formatting", CALLS_SQL)
def op7_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    linked = link_calls(calls_of(turns), results_of(turns), TOOLS, messages_of(turns))
    shown = linked.withColumn("problems", F.array_join("problems", "; ")).withColumn("line_md5", F.md5("line"))
    return shown.drop("line")
