"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

An assistant message that is a JSON object with tool_calls holds calls {id, name, arguments}; a tool message that is one
with tool_call_id holds a result. Calls and results of a conversation meet in a hash join by identifier. An argument
{"$ref": id} needs the result of another call, so calls have topological levels, found by relaxing one level a round until
none changes; calls in or behind a circle have none. Results follow their calls and calls the results that they need;
everything else keeps its turn. All of it is DataFrame operations, and a conversation with most of the messages is numbered
by ranges, not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, gapless, table

#: What an argument can be: a type's name, {field: (kind, needed)} of an object, or [kind] of an array.
Kind = str | dict[str, tuple["Kind", bool]] | list["Kind"]
#: Tools and their arguments: the kind of each, and whether it must be there.
SCHEMAS: dict[str, dict[str, tuple[Kind, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False), "filters": ([{"field": ("string", True), "value": ("string", False)}], False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "digits": ("integer", False)},
}
CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
TYPES = {"string": "STRING", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
#: An object whose only field is $ref.
REFERENCE = r"^OBJECT<`?\$ref`?: STRING>$"


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spare space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def is_reference(value: Column) -> Column:
    return F.schema_of_variant(value).rlike(REFERENCE)


def faults(value: Column, kind: Kind, path: str) -> Column:
    """What is wrong with a variant that isn't missing, as an array of strings; a reference to another call fits any kind."""
    found = F.schema_of_variant(value)
    if isinstance(kind, dict):
        inner = _fields(value, kind, f"{path}.")
        wrong = F.when(found.startswith("OBJECT"), inner).otherwise(F.array(F.lit(f"{path} is no object")))
    elif isinstance(kind, list):
        parts = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: faults(x, kind[0], f"{path}[]")))
        wrong = F.when(found.startswith("ARRAY"), F.array_distinct(parts)).otherwise(F.array(F.lit(f"{path} is no array")))
    else:
        if kind == "integer":  # 3.0 is one, as it is written 3
            number = F.try_variant_get(value, "$", "double")
            fits = (found == "BIGINT") | (found.rlike("^(DOUBLE|DECIMAL.*)$") & (number == F.floor(number)))
        else:
            fits = found.rlike(f"^({TYPES[kind]})$")
        wrong = F.when(F.coalesce(fits, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"{path} is no {kind}")))
    return F.when(is_reference(value), F.array().cast("array<string>")).otherwise(wrong)


def _fields(value: Column, fields: dict[str, tuple[Kind, bool]], before: str) -> Column:
    out = [F.array().cast("array<string>")]
    for field, (kind, needed) in fields.items():
        part = F.try_variant_get(value, f"$['{field}']", "variant")
        missing = F.array(F.lit(f"missing {before}{field}")) if needed else F.array().cast("array<string>")
        out.append(F.when(part.isNull(), missing).otherwise(faults(part, kind, before + field)))
    extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), F.array(*map(F.lit, fields)).cast("array<string>")))
    return F.concat(*out, F.transform(extra, lambda x: F.concat(F.lit(f"unexpected {before}"), x)))


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[Kind, bool]]]) -> Column:
    """What is wrong with a call's arguments, as an array of strings. schemas is a short dictionary stated by the caller."""
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        out = F.when(name == tool, _fields(value, fields, "")).otherwise(out)
    return F.when(value.isNull() | ~is_object, F.array(F.lit("arguments are no object"))).otherwise(out)


def _needs(calls: DataFrame) -> DataFrame:
    """(conv_id, id, other): the other calls that a call's arguments refer to, by any object with $ref alone in them."""
    # canonical JSON has no spare space, and a brace inside a string can't stand before its quotation mark unescaped
    inside = F.expr(r"""regexp_extract_all(to_json(try_parse_json(arguments)), '[:,\\[]\\{"\\$ref":"((?:[^"\\\\]|\\\\.)*)"\\}', 1)""")
    text = F.from_json(F.concat(F.lit('["'), F.array_join(F.array_distinct(inside), '","'), F.lit('"]')), "array<string>")
    return calls.filter("id is not null").select("conv_id", "id", F.explode(F.when(F.size(inside) > 0, text)).alias("other")).distinct()


def _levels(calls: DataFrame) -> DataFrame:
    """calls with level, the turn after which each can stand (anchor), and the references that no call answers (dangling).

    level is null in or behind a circle. calls has one row for each distinct call.
    """
    asked = _needs(calls)
    if asked.isEmpty():
        return calls.withColumns({"level": F.lit(0), "anchor": F.col("turn").cast("long"), "dangling": F.array().cast("array<string>")})
    asked = cut(asked)
    there = calls.select("conv_id", F.col("id").alias("other")).distinct()
    needs = cut(asked.join(there, ["conv_id", "other"]))
    # the references of one call are as many as its arguments hold
    dangling = asked.join(there, ["conv_id", "other"], "left_anti").groupBy("conv_id", "id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown reference "), "other"))).alias("dangling"))
    dangling = cut(dangling)  # written, so that the join can split an id that most calls have
    turns = calls.groupBy("conv_id", "id").agg(F.max("turn").cast("long").alias("turn"))
    known = turns.join(needs, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("anchor"))
    known, n = cut(known), -1
    while (now := known.count()) != n:  # each round settles the calls whose needs are all settled
        n = now
        met = needs.join(known.withColumnRenamed("id", "other"), ["conv_id", "other"], "left").join(known.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        ready = met.groupBy("conv_id", "id").agg(F.max("level").alias("l"), F.max("anchor").alias("a"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
        ready = ready.join(turns, ["conv_id", "id"]).select("conv_id", "id", (F.col("l") + 1).alias("level"), F.greatest("turn", "a").alias("anchor"))
        known = cut(known.unionByName(ready))
    out = calls.join(known, ["conv_id", "id"], "left").join(dangling, ["conv_id", "id"], "left")
    return out.withColumns({"anchor": F.coalesce("anchor", F.col("turn").cast("long")), "dangling": F.coalesce("dangling", F.array().cast("array<string>"))})


def format_chats(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row for each message (conv_id, turn, role, text): position, kind, level, status, problems and json.

    kind is call, result or message; status of a call is linked, unanswered, duplicate or circular, of a result linked,
    repeated (its call has an earlier one) or orphan, else null. A reference to a call that isn't there is a problem and
    orders nothing. json has sorted keys, the text of a plain message as content (null stays null), calls with canonical
    arguments. A message with several calls has one row, and the worst status of them. Repeated messages (equal turn, role
    and text) are rows of their own, whose calls count once and whose results are judged alike; a call's id is a duplicate
    where other messages, or the same one, use it again. Null roles and texts are plain messages, as is all JSON of another
    shape, however long. Equal turns stand by role and digest of the text; positions count from 0 in each conversation; a
    null conversation is one like any other for plain messages, but its calls and results find none. An empty table gives
    no rows; other columns are not read.
    """
    call, result = F.from_json("text", CALLS), F.from_json("text", RESULT)
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("row", F.md5("text"))
    is_call = (F.col("role") == "assistant") & F.startswith(F.ltrim("text"), F.lit("{")) & (F.size(call["tool_calls"]) > 0)
    is_result = (F.col("role") == "tool") & F.startswith(F.ltrim("text"), F.lit("{")) & result["tool_call_id"].isNotNull()
    kind = F.when(F.coalesce(is_call, F.lit(False)), "call").when(F.coalesce(is_result, F.lit(False)), "result").otherwise("message")
    rows = cut(rows.withColumn("kind", kind))
    out = rows.filter("kind = 'message'").withColumns({
        "anchor": F.col("turn").cast("long"), "depth": F.lit(0), "level": F.lit(None).cast("int"), "status": F.lit(None).cast("string"),
        "problems": F.array().cast("array<string>"), "calls": F.lit(None).cast("array<struct<arguments:string,id:string,name:string>>"), "answers": F.lit(None).cast("string"),
    })
    if not rows.filter("kind <> 'message'").isEmpty():
        out = out.unionByName(_linked(rows, call, result, schemas))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    asked = F.transform("calls", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(canonical(c["arguments"]), F.to_json(F.struct(c["arguments"].alias("raw")))), F.lit(","), F.substring(F.to_json(F.struct(c["id"].alias("id"), c["name"].alias("name")), {"ignoreNullFields": "false"}), 2, 1 << 30)))
    called = F.concat(F.lit('{"role":"assistant","tool_calls":['), F.array_join(asked, ","), F.lit("]}"))
    answered = F.to_json(F.struct(result["content"].alias("content"), "role", F.col("answers").alias("tool_call_id")), {"ignoreNullFields": "false"})
    out = out.withColumn("json", F.when(F.col("kind") == "call", called).when(F.col("kind") == "result", answered).otherwise(plain))
    numbered = gapless(out, ["conv_id"], ["anchor", "depth", "turn", "role", "row"], "position")
    return numbered.select("conv_id", "turn", "position", "role", "kind", "level", "status", "problems", "json")


def _linked(rows: DataFrame, call: Column, result: Column, schemas: dict) -> DataFrame:
    # equal messages have equal calls, which are looked at once
    distinct = rows.filter("kind = 'call'").dropDuplicates(["conv_id", "turn", "row"])
    calls = distinct.select("conv_id", "turn", "row", F.posexplode(call["tool_calls"]).alias("k", "c"))
    calls = cut(calls.select("conv_id", "turn", "row", "k", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments")))
    results = rows.filter("kind = 'result'").withColumn("id", result["tool_call_id"])
    counted = cut(calls.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n_calls")))
    answered = cut(results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("first_result")))
    placed = _levels(calls).withColumn("problems", F.concat(problems(F.col("name"), F.col("arguments"), schemas), "dangling"))
    placed = cut(placed)
    status = (
        F.when(F.col("id").isNull(), "unanswered").when(F.col("n_calls") > 1, "duplicate").when(F.col("level").isNull(), "circular")
        .when(F.col("first_result").isNull(), "unanswered").otherwise("linked")
    )
    placed = placed.join(counted, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left").withColumn("status", status)
    one = F.struct("k", F.struct("arguments", "id", "name").alias("c"))
    order = F.when(F.col("status") == "circular", 0).when(F.col("status") == "duplicate", 1).when(F.col("status") == "unanswered", 2).otherwise(3)
    # a message's own calls come together again; a message is one row of bounded size
    asked = placed.withColumn("worst", order).groupBy("conv_id", "turn", "row").agg(
        F.max("anchor").alias("anchor"), (2 * F.coalesce(F.min("level"), F.lit(0))).alias("depth"), F.max("level").alias("level"), F.min(F.struct("worst", "status"))["status"].alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("problems"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("calls"),
    )
    met = cut(asked.withColumnsRenamed({"conv_id": "v", "turn": "t", "row": "r"}))
    ours = rows.filter("kind = 'call'")
    ours = ours.join(met, ours["conv_id"].eqNullSafe(met["v"]) & ours["turn"].eqNullSafe(met["t"]) & (ours["row"] == met["r"]))
    ours = ours.select(*rows.columns, "anchor", "depth", "level", "status", "problems", "calls", F.lit(None).cast("string").alias("answers"))
    first = cut(placed.groupBy("conv_id", "id").agg(F.max("anchor").alias("call_at"), F.max("level").alias("level")).join(answered, ["conv_id", "id"]))
    own = F.struct("turn", "row").eqNullSafe(F.col("first_result"))
    theirs = results.join(first, ["conv_id", "id"], "left").select(
        *rows.columns, F.coalesce("call_at", F.col("turn").cast("long")).alias("anchor"), (2 * F.coalesce("level", F.lit(0)) + 1).alias("depth"), "level",
        F.when(F.col("call_at").isNull(), "orphan").when(own, "linked").otherwise("repeated").alias("status"),
        F.array().cast("array<string>").alias("problems"), F.lit(None).cast("array<struct<arguments:string,id:string,name:string>>").alias("calls"), F.col("id").alias("answers"),
    )
    return ours.unionByName(theirs)


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations table, formatted and in its place."""
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS position, role,
  'message' AS kind, CAST(NULL AS INTEGER) AS level, CAST(NULL AS VARCHAR) AS status, CAST([] AS VARCHAR[]) AS problems,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""
