"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet in a hash join on (conversation, call id).  Calls are ordered
topologically by what they wait for; arguments are parsed to a variant, checked
against the tool's schema, and every call is written as canonical JSON (keys sorted at
every depth, no white space, nulls kept).

Topological rank: 0 for a call that waits for nothing, else one more than the highest rank it
waits for.  Ready calls are peeled off round by round, all conversations at once; what waits for
itself, directly or through others, keeps a null rank.  There is a round for each rank,
and each is a hash join on (conversation, call id), so a conversation of any length is
spread over the tasks.

Defined results: a call without result has ``result`` null and status ``no_result``;
a result without call is a row of its own with status ``orphan``, however many have one id; of
several results for one call the earliest turn counts (then the smallest text) and the others
are not listed; repeated calls are rows of their own and share rank and result; calls of one id that
wait for different ones wait for all of them; arguments that are null or no JSON object are
invalid; unknown tools and unknown, missing or wrongly typed parameters are invalid; a null
conversation or call id links with nothing and nothing can wait for it, so every result with one
is an orphan of its own and every such call has rank 0; empty tables give
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lasting

#: name -> parameter -> (JSON type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]

# JSON schema types by the names that schema_of_variant gives.
TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL%"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT%"],
    "array": ["ARRAY%"],
    "null": ["VOID"],
}


def _valid(name: Column, v: Column, keys: Column, schemas: Schemas) -> Column:
    out = F.lit(False)
    for tool, params in schemas.items():
        ok = F.size(F.array_except(keys, F.array(*[F.lit(p) for p in params]))) == 0
        for p, (kind, needed) in params.items():
            got = F.schema_of_variant(F.try_variant_get(v, "$['%s']" % p.replace("'", "\\'"), "variant"))
            match = F.lit(False)
            for t in TYPES[kind]:
                match = match | got.like(t)
            there = F.array_contains(keys, p)
            ok = ok & (there & F.coalesce(match, F.lit(False)) if needed else ~there | F.coalesce(match, F.lit(False)))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def topological_rank(calls: DataFrame, ws: Workspace) -> DataFrame:
    """``calls`` (conv_id, call_id, turn, after array<string>) with ``rank``.

    ``after`` names the calls of the conversation that a call waits for; names that
    no call of the conversation has are ignored.
    """
    key = ["conv_id", "call_id"]
    keyed = calls.where("conv_id is not null and call_id is not null")
    nodes = ws.stash(keyed.select(*key).distinct(), "nodes")
    edges = keyed.select(*key, F.explode("after").alias("dep")).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    left = ws.stash(edges.join(known, ["conv_id", "dep"]), "edges")
    done, level = None, 0
    while True:
        waits = left.select(*key).distinct()
        ready = ws.stash(nodes.join(waits, key, "left_anti").withColumn("_rank", F.lit(level).cast("bigint")), "ready")
        done = ready if done is None else done.union(ready)
        # what is ready waits for nothing, so the rest is what still waits
        gone = ready.select("conv_id", F.col("call_id").alias("dep"))
        before, left = left, ws.stash(left.join(gone, ["conv_id", "dep"], "left_anti"), "edges")
        old, nodes = nodes, ws.stash(nodes.join(waits, key), "nodes")
        ws.drop(before, old)
        if not nodes.take(1) or not ready.take(1):
            break
        level += 1
    alone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    return calls.join(done, key, "left").withColumn("rank", F.when(alone, F.lit(0).cast("bigint")).otherwise(F.col("_rank"))).drop("_rank")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, ws: Workspace) -> DataFrame:
    """One row per call, and per result without a call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of call ids);
    results: conv_id, call_id, turn, content.
    """
    key = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*key, "turn", "name", "arguments", "after")
    called = calls.where(keyed).select(*key).distinct()
    # one shuffle of the results by key decides which have a call; the texts of several combine before they meet it
    found = results.select(*key, "turn", "content").where(keyed).join(called.withColumn("_k", F.lit(True)), key, "left")
    first = found.where("_k").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"))
    first = first.select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), F.lit(True).alias("_r"))
    ranked = topological_rank(calls, ws).withColumn("_c", F.lit(True))
    both = ranked.join(first, key, "left")
    # results with a null key meet no call: they stay out of the shuffle, which would bring them together
    orphans = found.where("_k is null").drop("_k").union(results.select(*key, "turn", "content").where(~keyed))
    both = both.unionByName(orphans.select(*key, F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.lit(True).alias("_r")), allowMissingColumns=True)
    v = F.try_parse_json("arguments")
    keys = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    call = F.col("_c").isNotNull()
    out = both.select(
        "conv_id", "call_id", "turn", "rank", "name", v.alias("_v"), "result_turn", "result",
        F.when(call, is_object & _valid(F.col("name"), v, keys, schemas)).alias("valid"),
        F.when(~call, "orphan").when(F.col("_r").isNull(), "no_result").otherwise("linked").alias("status"),
    )
    text = F.to_json(
        F.struct(F.col("_v").alias("arguments"), "call_id", "conv_id", "name", "rank", "result", "status", "valid"),
        {"ignoreNullFields": "false"},
    )
    return out.withColumn("json", text).drop("_v")


#: The schema under which the query's turns are checked.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation turns as calls and results: a user turn calls ``reply``, the assistant turn after it is its result.

    The call of turns 2 n and 2 n + 1 has number n.  It waits for number n div 4, as a plan is split
    into steps; every number 4 k + 1 also waits for the one said after it, which an order by turns
    gets wrong.  System turns are neither calls nor results.
    """
    turn = F.col("turn")
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    number = F.expr("turn div 2")
    known = F.col("conv_id").isNotNull() & turn.isNotNull()
    waits = F.array_compact(F.array(F.when(number > 0, key(F.expr("turn div 8"))), F.when(number % 4 == 1, key(number + 1))))
    calls = conversations.where("role = 'user'").select(
        "conv_id", F.when(known, key(number)).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"}).alias("arguments"), waits.alias("after"),
    )
    results = conversations.where("role = 'assistant'").select(
        "conv_id", F.when(known, key(F.expr("(turn - 1) div 2"))).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    calls, results = calls_of_turns(conversations)
    return link_tool_calls(calls, results, REPLY, lasting(spark, "op6"))


OP6_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, conv_id || ':' || (turn // 2) AS call_id, turn, turn // 2 AS n, text AS prompt
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, conv_id || ':' || ((turn - 1) // 2) AS call_id, turn, text AS content
  FROM conversations WHERE role = 'assistant'
), nodes AS (
  SELECT DISTINCT conv_id, call_id, n FROM calls WHERE call_id IS NOT NULL
), edges AS (
  SELECT a.conv_id, a.call_id, b.call_id AS dep FROM nodes a JOIN nodes b
    ON a.conv_id = b.conv_id AND ((a.n > 0 AND b.n = a.n // 4) OR (a.n % 4 = 1 AND b.n = a.n + 1))
), walk(conv_id, call_id, depth) AS (
  SELECT conv_id, call_id, 0 FROM nodes
  UNION
  SELECT e.conv_id, e.call_id, w.depth + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.dep = w.call_id
), ranks AS (
  SELECT conv_id, call_id, max(depth) AS rank FROM walk GROUP BY 1, 2
), first AS (
  SELECT conv_id, call_id, min(struct_pack(turn := turn, content := content)) AS r
  FROM results WHERE call_id IS NOT NULL GROUP BY 1, 2
), linked AS (
  SELECT c.conv_id, c.call_id, c.turn, CASE WHEN c.call_id IS NULL THEN 0 ELSE k.rank END AS rank, 'reply' AS name, c.prompt,
         f.r.turn AS result_turn, f.r.content AS result, c.prompt IS NOT NULL AND c.turn IS NOT NULL AS valid,
         CASE WHEN f.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM calls c LEFT JOIN ranks k ON k.conv_id = c.conv_id AND k.call_id = c.call_id
    LEFT JOIN first f ON f.conv_id = c.conv_id AND f.call_id = c.call_id
  UNION ALL
  SELECT conv_id, call_id, NULL, NULL, NULL, NULL, turn, content, NULL, 'orphan' FROM results r
  WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
)
SELECT conv_id, call_id, turn, rank, name, result_turn, result, valid, status,
       CAST(json_object('arguments', CASE WHEN name IS NULL THEN NULL ELSE json_object('prompt', prompt, 'turn', turn) END,
                   'call_id', call_id, 'conv_id', conv_id, 'name', name, 'rank', rank, 'result', result,
                   'status', status, 'valid', valid) AS VARCHAR) AS json
FROM linked
"""
