"""Tool-call linking for chat data, with built-in expressions only.

* Calls and results are hash-joined by (conv_id, call_id); of several results the
  earliest is taken and all are counted; results without a call are rows too.
* Calls are ordered topologically by the calls they depend on: ``level`` is the
  longest chain of dependencies below a call, ``ord`` the place in the
  conversation by (level, position, call_id).  Calls in or behind a cycle have
  no level and come last.
* Arguments are checked against the tool's parameters (type, required, minimum).
* Each linked call becomes canonical JSON: keys sorted at every depth, no white
  space, numbers in one form.

Cases: a null conv_id is a conversation of its own; calls without an id never
link and have the error ``no_id``; calls that share an id have ``duplicate_id``,
the same level and result; arguments that aren't a JSON object have
``not_object``; repeated dependencies count once, unknown ones are errors and
ignored; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import dropped, written

#: Positions that one task ranks together.
BUCKET = 1024


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, id, level) of every node; edges (conv, id, dep) between them; level is null in and behind cycles."""
    edges = written(edges.distinct(), "dependencies")
    several = written(edges.groupBy("conv", "id").count().filter("count > 1").select("conv").distinct(), "several")
    if not several.limit(1).count():
        return _jumped(nodes, edges)
    # only conversations with a call that has several dependencies go level by level
    few = _jumped(nodes.join(several, "conv", "left_anti"), edges.join(several, "conv", "left_anti"))
    return few.unionByName(_peeled(nodes.join(several, "conv", "left_semi"), edges.join(several, "conv", "left_semi")))


def _jumped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """At most one dependency each: pointers are followed twice as far in every round."""
    now = written(nodes.join(edges, ["conv", "id"], "left").withColumn("far", F.col("dep").isNotNull().cast("long")), "levels")
    for _ in range(ceil(log2(now.count() + 2)) + 1):
        if not now.filter("dep is not null").limit(1).count():
            break
        up = now.select("conv", F.col("id").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"))
        far = F.col("far") + F.coalesce("more", F.lit(0))
        before, now = now, written(now.join(up, ["conv", "dep"], "left").select("conv", "id", F.col("next").alias("dep"), far.alias("far")), "levels")
        dropped(before)
    return now.select("conv", "id", F.when(F.col("dep").isNull(), F.col("far")).alias("level"))


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Any number of dependencies: the nodes whose dependencies all have a level get the next one, round by round."""
    left, rest, out, level = written(nodes, "nodes"), written(edges, "dependencies"), None, 0
    while True:
        ready = written(left.join(rest.select("conv", "id").distinct(), ["conv", "id"], "left_anti"), "ready")
        if not ready.limit(1).count():
            missing = left.withColumn("level", F.lit(None).cast("long"))
            return missing if out is None else out.union(missing)
        done = ready.withColumn("level", F.lit(level).cast("long"))
        out = done if out is None else out.union(done)
        before = left, rest
        left = written(left.join(ready, ["conv", "id"], "left_anti"), "nodes")
        rest = written(rest.join(ready.withColumnRenamed("id", "dep"), ["conv", "dep"], "left_anti"), "dependencies")
        dropped(*before)
        level += 1


def argument_errors(arguments: Column, known: Column, params: Column) -> Column:
    """Sorted errors of a JSON text against params, an array of (param, type, required, minimum)."""
    values = F.from_json(arguments, "map<string,variant>")
    names = F.map_keys(values)

    def wrong(p: Column) -> Column:
        v = F.try_element_at(values, p["param"])
        kind = F.schema_of_variant(v)
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        whole = (kind == "BIGINT") | kind.rlike(r",0\)$")
        fits = (
            F.when(p["type"] == "string", kind == "STRING")
            .when(p["type"] == "integer", whole)
            .when(p["type"] == "number", number)
            .when(p["type"] == "boolean", kind == "BOOLEAN")
            .when(p["type"] == "array", kind.startswith("ARRAY"))
            .when(p["type"] == "object", kind.startswith("OBJECT"))
            .otherwise(F.lit(True))
        )
        small = number & (F.try_variant_get(v, "$", "double") < p["minimum"])
        absent = ~F.array_contains(names, p["param"])
        return (
            F.when(absent, F.when(p["required"], F.concat(F.lit("missing:"), p["param"])))
            .when(~fits, F.concat(F.lit("type:"), p["param"]))
            .when(small, F.concat(F.lit("minimum:"), p["param"]))
        )

    extra = F.transform(F.array_except(names, F.transform(params, lambda p: p["param"])), lambda n: F.concat(F.lit("unexpected:"), n))
    found = F.concat(F.filter(F.transform(params, wrong), lambda e: e.isNotNull()), extra)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("not_object"))).when(~known, F.array(F.lit("unknown_tool"))).otherwise(F.sort_array(found))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, position, name, arguments, after), results (conv_id, call_id, position, content) and
    schemas (name, param, type, required, minimum) to one row for each call and each group of results without a call."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv")
    calls = calls.select(conv, "conv_id", "call_id", "position", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    nodes = calls.filter("call_id is not null").groupBy("conv", F.col("call_id").alias("id")).agg(F.count("call_id").alias("calls"))
    wanted = calls.filter("call_id is not null").select("conv", F.col("call_id").alias("id"), F.explode("after").alias("dep")).distinct()
    wanted = wanted.join(nodes.select("conv", F.col("id").alias("dep"), F.lit(True).alias("there")), ["conv", "dep"], "left")
    wanted = written(wanted, "wanted")
    lost = wanted.filter("there is null").groupBy("conv", "id").agg(F.sort_array(F.collect_set(F.concat(F.lit("unknown_dependency:"), F.coalesce("dep", F.lit(""))))).alias("lost"))
    level = levels(nodes.select("conv", "id"), wanted.filter("there").select("conv", "id", "dep"))
    graph = nodes.join(level, ["conv", "id"]).join(lost, ["conv", "id"], "left").withColumnRenamed("id", "call_id")

    answer = results.select(conv, "conv_id", "call_id", "position", "content").groupBy("conv", "conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min_by(F.struct("content"), F.struct("position", "content")).alias("result"))
    tools = schemas.filter("name is not null").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("param", "type", "required", F.col("minimum").cast("double").alias("minimum")))).alias("params"))
    out = calls.drop("after").join(answer.drop("conv_id").hint("shuffle_hash"), ["conv", "call_id"], "left").join(graph, ["conv", "call_id"], "left").join(tools, "name", "left")

    none = F.array().cast("array<string>")
    own = F.when(F.col("call_id").isNull(), F.array(F.lit("no_id"))).when(F.col("calls") > 1, F.array(F.lit("duplicate_id"))).otherwise(none)
    cyclic = F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none)
    errors = F.concat(own, cyclic, F.coalesce("lost", none), argument_errors(F.col("arguments"), F.col("params").isNotNull(), F.coalesce("params", F.array().cast(tools.schema["params"].dataType))))
    level = F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level"))
    body = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id"), F.col("name"), F.col("result.content").alias("result"))
    out = out.select(
        "conv", "conv_id", "call_id", "name", "position", level.alias("level"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("n_results") > 0, "linked").otherwise("no_result").alias("status"), errors.alias("errors"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )
    orphans = answer.join(nodes.select("conv", F.col("id").alias("call_id")), ["conv", "call_id"], "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    orphans = orphans.select("conv", "conv_id", "call_id", null("string"), null("long"), null("long"), "n_results", F.lit("orphan_result"), none, null("string"))
    ranked = _ranked(written(out, "linked"))
    return ranked.unionByName(orphans.toDF(*out.columns).withColumn("ord", null("long"))).drop("conv")


def _ranked(rows: DataFrame) -> DataFrame:
    """``ord`` from 0 in each conversation by (level, position, call_id).

    Calls are ranked within buckets of a level and BUCKET positions, buckets
    within bands of BUCKET levels, and bands within the conversation, so that no
    task ranks a whole long conversation, be it wide or deep.
    """
    late, part = F.coalesce("level", F.lit(2**62)), F.floor(F.coalesce("position", F.lit(-1)) / BUCKET)
    keyed = rows.withColumn("_late", late).withColumn("_band", F.floor(late / BUCKET)).withColumn("_part", part)
    bucket = ["conv", "_band", "_late", "_part"]
    counts = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    bands = counts.groupBy("conv", "_band").agg(F.sum("_n").alias("_all"))
    bands = bands.withColumn("_first", F.sum("_all").over(Window.partitionBy("conv").orderBy("_band")) - F.col("_all")).drop("_all")
    within = F.sum("_n").over(Window.partitionBy("conv", "_band").orderBy("_late", "_part")) - F.col("_n")
    before = counts.withColumn("_before", within).drop("_n").join(bands, ["conv", "_band"])
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("position", "call_id", "json"))
    out = keyed.withColumn("_row", inside).join(before, bucket).withColumn("ord", F.col("_first") + F.col("_before") + F.col("_row") - 1)
    return out.drop("_late", "_band", "_part", "_row", "_before", "_first")


#: Tools of the query: conversations have no tool calls, so their turns stand for them.
TOOLS = [("open_topic", "text", "string", True, None), ("open_topic", "turn", "integer", True, None), ("open_topic", "words", "integer", True, 3.0), ("follow_up", "text", "string", True, None), ("follow_up", "turn", "integer", True, 2.0), ("follow_up", "words", "integer", True, 10.0)]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and system turns as calls, each after the turn two before it; assistant turns as results of the turn before them."""
    turn = F.col("turn").cast("long")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    name = F.when(F.col("role") == "system", "set_context").when(turn <= 1, "open_topic").otherwise("follow_up")
    identity = lambda t: F.concat(F.lit("c"), t.cast("string"))
    after = F.when(turn >= 2, F.array(identity(turn - 2))).otherwise(F.array().cast("array<string>"))
    arguments = F.to_json(F.struct(words.alias("words"), turn.alias("turn"), F.col("text").alias("text")))
    calls = conversations.filter("role in ('user', 'system')").select("conv_id", identity(turn).alias("call_id"), turn.alias("position"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", identity(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls, results


def schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean, minimum double")


def op4_tool_calls(conversations: DataFrame) -> DataFrame:
    """One row for each call of every conversation, and for each result without a call."""
    calls, results = calls_of(conversations.select("conv_id", "turn", "role", "text"))
    out = link(calls, results, schemas(conversations.sparkSession))
    return out.select("conv_id", "call_id", "name", "level", "ord", "n_results", "status", F.array_join("errors", ",").alias("errors"), "json")


ORACLE = r"""
WITH calls AS (
  SELECT conv_id, turn::BIGINT AS turn, 'c' || turn AS call_id, text,
    CASE WHEN role = 'system' THEN 'set_context' WHEN turn <= 1 THEN 'open_topic' ELSE 'follow_up' END AS name,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM conversations WHERE role IN ('user', 'system')),
results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, count(*) AS n_results, arg_min(text, turn) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
levels AS (
  WITH RECURSIVE l AS (
    SELECT conv_id, turn, 0::BIGINT AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2)
    UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM calls c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
  SELECT * FROM l),
linked AS (
  SELECT c.*, l.level, coalesce(r.n_results, 0) AS n_results, r.content,
    turn >= 2 AND NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2) AS lost
  FROM calls c JOIN levels l USING (conv_id, turn) LEFT JOIN results r USING (conv_id, call_id))
SELECT conv_id, call_id, name, level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) - 1 AS ord, n_results,
  CASE WHEN n_results > 0 THEN 'linked' ELSE 'no_result' END AS status,
  concat_ws(',', CASE WHEN lost THEN 'unknown_dependency:c' || (turn - 2) END,
    CASE WHEN name = 'set_context' THEN 'unknown_tool' WHEN words < CASE name WHEN 'open_topic' THEN 3 ELSE 10 END THEN 'minimum:words' END) AS errors,
  '{"arguments":{"text":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '},"call_id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM linked
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, NULL, r.n_results, 'orphan_result', '', NULL
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
