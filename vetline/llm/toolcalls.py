"""Tool-call linking for chat data.

Calls and results meet by a hash join on (conversation, identifier). A call may
name the call whose result it uses; chains of such links are measured by
pointer doubling, which gives each call its depth, and (depth, turn, id) is a
topological order. Arguments are parsed as JSON and held against the tool's
schema, and every call becomes one line of canonical JSON: keys sorted, no
white space, absent and null fields left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetline.llm.common import stored, table

# Tool -> field -> (type, required). Types: string, integer, number, boolean.
Tools = dict[str, dict[str, tuple[str, bool]]]
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
VARIANT_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}

TOOLS: Tools = {
    "lookup": {"query": ("string", True), "words": ("integer", False)},
    "search": {"query": ("string", True), "turn": ("integer", True)},
}


def json_text(c: Column) -> Column:
    """A string as a JSON value; null as ``null``."""
    listed = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def argument_problem(name: Column, arguments: Column, tools: Tools) -> Column:
    """What is wrong with a call, null if nothing: unknown_tool, not_json,
    unknown_field, missing_field or wrong_type, the first that applies."""
    parsed, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    judged = F.lit("unknown_tool")
    for tool, fields in tools.items():
        missing = wrong = F.lit(False)
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            seen = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
            absent = value.isNull() | (seen == "VOID")
            if required:
                missing = missing | absent
            wrong = wrong | (~absent & ~seen.isin(VARIANT_TYPES[kind]))
        known = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        one = (F.when(parsed.isNull() | keys.isNull(), "not_json")
               .when(F.size(F.array_except(keys, known)) > 0, "unknown_field")
               .when(missing, "missing_field").when(wrong, "wrong_type"))
        judged = F.when(name == tool, one).otherwise(judged)
    return judged


def canonical_arguments(name: Column, arguments: Column, tools: Tools) -> Column:
    out = F.lit(None).cast("string")
    for tool, fields in tools.items():
        schema = ", ".join(f"`{f}` {SQL_TYPES[fields[f][0]]}" for f in sorted(fields))
        out = F.when(name == tool, F.to_json(F.from_json(arguments, schema)) if fields else F.lit("{}")).otherwise(out)
    return out


def chain_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after) with unique ids to (conv_id, call_id, depth):
    the number of calls before it on its chain; null on a cycle or behind one.
    A link to a call that is not there counts as none."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = stored(calls.join(known, ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up"),
        F.coalesce(F.col("there").cast("long"), F.lit(0)).alias("depth")), "chain")
    rounds = math.ceil(math.log2(max(state.count(), 1) + 1)) + 1
    for _ in range(rounds):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = stored(state.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chain")
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place (from 1) in its group.

    A range shuffle on group and order spreads even one huge group over all
    tasks; places inside a range follow from local counts, and the ranges'
    totals (one row per range) are added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, group, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    local = Window.partitionBy("__range").orderBy(group, *order)
    numbered = stored(ranged.withColumn("__at", F.row_number().over(local)), "numbered")
    totals = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = totals.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    placed = numbered.join(F.broadcast(before), "__range").withColumn("__at", F.col("__at") + F.col("__before"))
    firsts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__at").alias("__first"))
    return placed.join(stored(firsts, "firsts"), F.col(group).eqNullSafe(F.col("__group"))).withColumn(
        name, (F.col("__at") - F.col("__first") + 1).cast("long")).drop("__range", "__at", "__before", "__group", "__first")


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    """One row per call and per result that meets no call.

    ``calls``: conv_id, call_id, turn, name, arguments, after; ``results``:
    conv_id, call_id, turn, content; further columns are not read. ``status``:
    linked, no_result, orphan_result, no_id (a null identifier or conversation joins nothing),
    repeated (an identifier already used by an earlier call of the conversation)
    or cycle. Of several results to a call the first by turn and content is
    taken and ``n_results`` counts them. ``position`` is the row's place in the
    conversation's topological order (repeated rows keep their own places, rows
    without depth come last). ``line`` is null unless the call is linked and
    its arguments are valid."""
    own = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after").withColumn(
        "order_key", F.struct("turn", "name", "arguments", "after"))
    named = "call_id is not null and conv_id is not null"
    firsts = own.filter(named).groupBy("conv_id", "call_id").agg(
        F.min("order_key").alias("first"), F.count("*").alias("uses"))
    firsts = stored(firsts, "calls")
    answers = stored(results.filter(named).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results")), "results")
    depths = chain_depths(firsts.select("conv_id", "call_id", F.col("first")["after"].alias("after")))

    linked = firsts.join(depths, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "full_outer")
    main = linked.select(
        "conv_id", "call_id", F.coalesce(F.col("first")["turn"], F.col("answer")["turn"]).alias("turn"),
        F.col("first")["name"].alias("name"), F.col("first")["arguments"].alias("arguments"), "depth",
        F.col("answer")["content"].alias("content"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("first").isNull(), "orphan_result").when(F.col("depth").isNull(), "cycle")
         .when(F.col("answer").isNull(), "no_result").otherwise("linked").alias("status"), F.lit(0).alias("copy"))
    again = firsts.filter("uses > 1").select("conv_id", "call_id", F.col("first").alias("kept"))
    nth = own.join(again, ["conv_id", "call_id"])
    # equal copies of the first call: all but one are repeats
    extra = nth.groupBy("conv_id", "call_id", "order_key", "kept").agg(F.count("*").alias("n")).withColumn(
        "n", F.col("n") - (F.col("order_key") == F.col("kept")).cast("int")).filter("n > 0")
    extra = extra.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    loose = own.filter(f"not ({named})").select("*", F.lit("no_id").alias("status"), F.lit(0).alias("copy")).unionByName(
        extra.select("conv_id", "call_id", F.col("order_key")["turn"].alias("turn"), F.col("order_key")["name"].alias("name"),
                     F.col("order_key")["arguments"].alias("arguments"), F.col("order_key")["after"].alias("after"), "order_key",
                     F.lit("repeated").alias("status"), "copy"))
    loose = loose.select("conv_id", "call_id", "turn", "name", "arguments", F.lit(None).cast("long").alias("depth"),
                         F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("n_results"), "status", "copy")
    nameless = results.filter(f"not ({named})").select(
        "conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("long").alias("depth"), "content", F.lit(1).cast("long").alias("n_results"),
        F.lit("orphan_result").alias("status"), F.lit(0).alias("copy"))
    rows = main.unionByName(loose).unionByName(nameless)
    rows = rows.withColumn("problem", F.when(F.col("status") != "orphan_result", argument_problem(F.col("name"), F.col("arguments"), tools)))
    fine = (F.col("status") == "linked") & F.col("problem").isNull()
    line = F.concat(F.lit('{"arguments":'), canonical_arguments(F.col("name"), F.col("arguments"), tools),
                    F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'), json_text(F.col("name")),
                    F.lit(',"result":'), json_text(F.col("content")), F.lit("}"))
    rows = rows.select("conv_id", "call_id", "turn", "name", "depth", "status", "n_results", "problem", F.when(fine, line).alias("line"),
                       F.coalesce("depth", F.lit(2**62)).alias("__level"), "copy")
    return positions(rows, "conv_id", ["__level", "turn", "call_id", "copy"], "position").drop("__level", "copy")


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user turn calls a tool
    (``lookup`` for texts under 200 characters, else ``search``) with its text
    as query, the next turn of the assistant answers it, and a call uses the
    answer to the user turn two turns back."""
    ident = lambda c: F.concat(F.lit("call-"), c.cast("string"))
    short = F.length(F.coalesce("text", F.lit(""))) < 200
    query = F.nullif(F.col("text"), F.lit(""))
    n_words = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")
    calls = messages.filter("role = 'user'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.when(short, "lookup").otherwise("search").alias("name"),
        F.when(short, F.to_json(F.struct(n_words.alias("words"), query.alias("query"))))
         .otherwise(F.to_json(F.struct("turn", query.alias("query")))).alias("arguments"),
        ident(F.col("turn") - 2).alias("after"))
    results = messages.filter("role = 'assistant'").select(
        "conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(table(spark, sf_dir, "conversations")), TOOLS)


OP7_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'call-' || turn AS call_id, 'call-' || (turn - 2) AS after,
         CASE WHEN length(coalesce(text, '')) < 200 THEN 'lookup' ELSE 'search' END AS name
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
chain AS (
  SELECT conv_id, call_id, 0 AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, chain.depth + 1 FROM calls c JOIN chain ON c.conv_id = chain.conv_id AND c.after = chain.call_id),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
         coalesce(c.turn, r.turn) AS turn, c.name, chain.depth, r.content, c.text,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         CAST(CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
         CASE WHEN c.call_id IS NOT NULL AND coalesce(c.text, '') = '' THEN 'missing_field' END AS problem
  FROM calls c JOIN chain USING (conv_id, call_id) FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, CAST(depth AS BIGINT) AS depth, status, n_results, problem,
       CASE WHEN status = 'linked' AND problem IS NULL THEN
         '{"arguments":{"query":' || CAST(to_json(text) AS VARCHAR) ||
         CASE name WHEN 'lookup' THEN ',"words":' || len(list_filter(string_split(text, ' '), lambda w: w <> ''))
                   ELSE ',"turn":' || turn END ||
         '},"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || CAST(to_json(name) AS VARCHAR) ||
         ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' END AS line,
       row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 4611686018427387904), turn, call_id) AS position
FROM linked
"""
