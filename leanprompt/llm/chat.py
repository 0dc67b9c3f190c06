"""Tool-call linking for chat formatting, in DataFrame functions alone (operator 6).

Calls and results meet by a hash join on (scope, call identifier); calls are ordered topologically by what they depend on;
arguments, a JSON text, are parsed and validated against their tool's schema; what comes out is canonical JSON (keys
sorted, no white space).

The `conversations` table has no tool traffic of its own, so the query reads it as such: each user turn is a call of the
tool "reply" with identifier "conv:turn" and depends on the nearest earlier user or system turn, at any distance; each
assistant turn is the result of the turn before it. System turns are calls of the tool "system". A conversation's turns are
looked at by runs of RUN turn numbers, so that no task gets all turns of a long one.

Defined results: a null conversation or turn identifies nothing and is left out; a null text is the JSON null and violates
the schema (required string); empty texts are valid; arguments that are null, no JSON or no object violate it; a repeated
(conv_id, turn) counts once, with its smallest row; a result without its call has status "orphan" and no tool, turn or
level; a call without a result has status "pending". A cycle of dependencies gets no level (null) and status "cycle".
Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: tool -> [(argument, kind, required)]
SCHEMAS = {"reply": [("text", "string", True), ("turn", "integer", True)], "system": [("text", "string", True), ("turn", "integer", True)]}
#: how the parsed value's type begins, by kind
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
RUN_LOG2 = 10  # turn numbers of a run: 1,024


def quoted(c: Column) -> Column:
    """A JSON string, by Spark's own JSON writer; null is JSON null."""
    whole = F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"})  # {"v":...}
    return F.substring(whole, 6, F.length(whole) - 6)


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of fields whose values are JSON texts already, keys sorted."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scope, id, level) of nodes(scope, id): 0 for those that depend on none, else one more than the highest they depend on, null in or behind a cycle.

    edges(scope, id, parent). Paths double in each round: after k rounds every way of up to 2 ** k steps is known, so
    that the rounds grow with the logarithm of the longest chain. Chains here are forests (one parent each) or are
    reduced to their longest way by a grouped maximum.
    """
    known = keep(edges.join(nodes.select("scope", F.col("id").alias("parent")), ["scope", "parent"], "left_semi").distinct())
    # ways(scope, id, up, steps, ended): up is the node reached after steps
    ways = keep(nodes.join(known, ["scope", "id"], "left").select("scope", "id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    limit = max(1, ways.where("up is not null").count())
    rounds = 0
    while not ways.where("up is not null").isEmpty() and (1 << rounds) <= 2 * limit:
        on = ways.select("scope", F.col("id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        done = ways.where("up is null")
        longer = ways.where("up is not null").join(on, ["scope", "up"]).groupBy("scope", "id", F.col("far").alias("up")).agg(F.max(F.col("steps") + F.col("more")).alias("steps"))
        ways = keep(done.unionByName(longer).groupBy("scope", "id", "up").agg(F.max("steps").alias("steps")))
        rounds += 1
    return ways.groupBy("scope", "id").agg(F.when(F.max(F.col("up").isNotNull()), F.lit(None)).otherwise(F.max("steps")).cast("long").alias("level"))


def violations(tool: Column, arguments: Column, schemas: dict | None = None) -> Column:
    """The schema violations of a call whose parsed arguments are a variant, sorted and joined by commas; "" if it is valid."""
    schemas = SCHEMAS if schemas is None else schemas
    known = F.coalesce(tool.isin(*schemas), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    found = [F.when(~known, F.lit("unknown tool")), F.when(known & ~is_object, F.lit("arguments: not an object"))]
    for name, schema in schemas.items():
        here = (tool == name) & is_object
        for arg, kind, required in schema:
            has = F.schema_of_variant(F.try_variant_get(arguments, f"$.{arg}", "variant"))
            none = has.isNull() | (has == "VOID")
            if required:
                found.append(F.when(here & none, F.lit(f"{arg}: missing")))
            fits = F.lit(False)
            for begin in KINDS[kind]:
                fits = fits | has.startswith(begin)
            found.append(F.when(here & ~none & ~fits, F.lit(f"{arg}: not {kind}")))
    return F.concat_ws(",", F.array_sort(F.array_compact(F.array(*found))))


def link(calls: DataFrame, results: DataFrame, depends: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row for each call of calls(scope, id, tool, arguments) and each orphan result: level, violations, status and
    canonical JSON.

    results(scope, id, output) are joined by identifier; depends(scope, id, parent) orders.
    """
    order = levels(depends, calls.select("scope", "id"))
    parsed = calls.select("scope", "id", "tool", F.try_parse_json("arguments").alias("parsed"), F.lit(True).alias("called"))
    answers = results.select("scope", "id", "output", F.lit(True).alias("answered"))
    called, have = (F.coalesce(F.col(c), F.lit(False)) for c in ("called", "answered"))
    rows = parsed.join(answers, ["scope", "id"], "full").join(order, ["scope", "id"], "left")
    rows = rows.withColumn("wrong", F.when(called, violations(F.col("tool"), F.col("parsed"), schemas)).otherwise(""))
    status = F.when(~called, "orphan").when(F.col("level").isNull(), "cycle").when(F.col("wrong") != "", "invalid").when(have, "linked").otherwise("pending")
    body = canonical({"arguments": F.coalesce(F.to_json("parsed"), F.lit("null")), "id": quoted(F.col("id")), "name": quoted(F.col("tool")), "result": F.when(have, quoted(F.col("output"))).otherwise("null")})
    return rows.select("scope", "id", "tool", "level", F.col("wrong").alias("violations"), status.alias("status"), body.alias("json"))


def nearest_earlier(turns: DataFrame) -> DataFrame:
    """(scope, turn, before) of turns(scope, turn) with an earlier one in their scope: the nearest, at any distance."""
    run = F.shiftright("turn", RUN_LOG2).alias("run")
    inside = F.lag("turn").over(Window.partitionBy("scope", "run").orderBy("turn"))
    here = turns.select("scope", "turn", run).withColumn("inside", inside)
    ends = turns.groupBy("scope", run).agg(F.max("turn").alias("last"))
    ends = ends.select("scope", "run", F.lag("last").over(Window.partitionBy("scope").orderBy("run")).alias("outside")).where("outside is not null")
    firsts = here.where("inside is null").join(ends, ["scope", "run"]).select("scope", "turn", F.col("outside").alias("before"))
    return here.where("inside is not null").select("scope", "turn", F.col("inside").alias("before")).unionByName(firsts)


def traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of a conversations table."""
    rows = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("r")).select(F.col("conv_id").alias("scope"), "turn", "r.role", "r.text")
    name = lambda turn: F.concat_ws(":", F.col("scope").cast("string"), turn.cast("string"))
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    of_call = F.col("role").isin("user", "system")
    calls = rows.where(of_call).select("scope", name(F.col("turn")).alias("id"), F.when(F.col("role") == "user", "reply").otherwise("system").alias("tool"), arguments.alias("arguments"))
    results = rows.where("role = 'assistant'").select("scope", name(F.col("turn") - 1).alias("id"), F.col("text").alias("output"))
    near = nearest_earlier(rows.where(of_call).select("scope", "turn"))
    return calls, results, near.select("scope", name(F.col("turn")).alias("id"), name(F.col("before")).alias("parent"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(*traffic(table(spark, sf_dir, "conversations")))
    turn = F.when(F.col("status") != "orphan", F.substring_index("id", ":", -1).cast("long"))
    return out.select(F.col("scope").alias("conv_id"), turn.alias("turn"), F.col("id").alias("call_id"), "tool", "level", "violations", "status", "json")


ORACLE = r"""
WITH once AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) = 1),
asked AS (
  SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level
  FROM once WHERE role = 'user' OR role = 'system'),
answers AS (SELECT conv_id, turn - 1 AS turn, text AS output FROM once WHERE role = 'assistant'),
paired AS (
  SELECT conv_id, turn, coalesce(a.role IS NOT NULL, false) AS called, r.conv_id IS NOT NULL AS answered, a.role, a.text, a.level, r.output
  FROM asked a FULL JOIN (SELECT *, true AS t FROM answers) r USING (conv_id, turn))
SELECT conv_id, CASE WHEN called THEN turn END AS turn, conv_id || ':' || turn AS call_id,
  CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'system' END AS tool, CAST(level AS BIGINT) AS level,
  CASE WHEN called AND text IS NULL THEN 'text: missing' ELSE '' END AS violations,
  CASE WHEN NOT called THEN 'orphan' WHEN text IS NULL THEN 'invalid' WHEN answered THEN 'linked' ELSE 'pending' END AS status,
  '{"arguments":' || CASE WHEN called THEN CAST(json_object('text', text, 'turn', turn) AS VARCHAR) ELSE 'null' END
    || ',"id":' || CAST(to_json(conv_id || ':' || turn) AS VARCHAR)
    || ',"name":' || CASE role WHEN 'user' THEN '"reply"' WHEN 'system' THEN '"system"' ELSE 'null' END
    || ',"result":' || CASE WHEN answered THEN coalesce(CAST(to_json(output) AS VARCHAR), 'null') ELSE 'null' END || '}' AS json
FROM paired
"""

QUERIES = {"op6_tool_calls": op6_tool_calls}
ORACLES = {"op6_tool_calls": ORACLE}
