"""Chat formatting with tool-call linking, in DataFrame operations only.

Calls and results meet in a hash join on their identifier. They are put in a
topological order: a row's position is its turn, or that of what it depends on if
that stands later, and its depth says how many links lie before it. A result depends on
its call, and a call that a result issues depends on that result; such chains are followed
link by link, in joins of all conversations at once, so none is ever gathered. Arguments
are parsed and checked field by field, by their types, against a table of schemas. Each
line is canonical JSON: keys in order at every level, no white space, nulls written.

A conversation's tool calls are the entries of ``tool_calls`` (id, name, arguments) of
a text that is a JSON object; results are texts of role ``tool`` with
``tool_call_id`` and ``content``. Where there are none, a user's turn is a call of
``reply`` with its text as the argument, and the assistant's next turn its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import settle

#: The types of a parsed value that are of each kind (fixed values).
KINDS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}
REPLY = "reply"
CALLS = "tool_calls array<struct<id: string, name: string, arguments: string>>, tool_call_id string, content string"
FIELDS = "name string, field string, kind string, required boolean"
#: Up to so many rows a table of schemas is broadcast.
SCHEMAS_BROADCAST = 100_000


def schema_table(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """A table of argument schemas: (name, field, kind, required); kinds are those of ``KINDS``."""
    return spark.createDataFrame(rows, FIELDS)


def _canonical(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``valid``: ``arguments`` is a JSON object that has every required field of the call's name, and each is of its kind.

    A field that is null counts as missing. Fields that the schema does not name may be there.
    Arguments that are no JSON object (or name a key twice) are not valid, and neither is a
    name without a schema.
    """
    own = schemas.filter("name is not null").groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("fields"))
    if schemas.count() <= SCHEMAS_BROADCAST:
        own = F.broadcast(own)
    parsed = F.expr("try_cast(try_parse_json(arguments) as map<string, variant>)")
    pattern = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])

    def good(f: Column) -> Column:
        kind = F.schema_of_variant(F.try_element_at("parsed", f["field"]))
        fits = F.regexp_like(kind, F.coalesce(F.try_element_at(pattern, f["kind"]), F.lit("(?!)")))
        return F.when(kind.isNull() | (kind == "VOID"), ~F.coalesce(f["required"], F.lit(False))).otherwise(fits)

    joined = calls.join(own, "name", "left").withColumn("parsed", parsed)
    return joined.withColumn("valid", F.coalesce(F.col("parsed").isNotNull() & F.forall("fields", good), F.lit(False))).drop("parsed", "fields")


def _ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, key, call_position, call_depth) of the first call of each identifier (conv_id, key, turn, parent).

    Calls without a parent, or with one that is no call, come first; then, level by
    level, those that their results issue. Calls that wait for one another in a circle
    keep their turn, at depth 0.
    """
    now = calls.select("conv_id", "key", F.col("turn").alias("call_position"), F.lit(0).alias("call_depth"))
    waiting = calls.filter("parent is not null").select("conv_id", "key", "parent", "turn")
    if waiting.isEmpty():
        return now
    names = calls.select("conv_id", F.col("key").alias("parent"))
    waiting = settle(waiting.join(names, ["conv_id", "parent"], "left_semi"), "waiting")
    level = settle(now.join(waiting, ["conv_id", "key"], "left_anti"), "level")
    done = [level]
    while True:
        before = level.select("conv_id", F.col("key").alias("parent"), "call_position", "call_depth")
        level = waiting.join(before, ["conv_id", "parent"]).select("conv_id", "key", F.greatest("turn", "call_position").alias("call_position"), (F.col("call_depth") + 2).alias("call_depth"))
        level = settle(level, "level")
        if level.isEmpty():
            break
        done.append(level)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = settle(out, "ordered")
    return out.unionByName(now.join(out, ["conv_id", "key"], "left_anti"))


def format_chats(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, position, depth, kind, call_id, linked, valid, repeated, copies and line, a row per call, result or message.

    kind is call, result or message. linked says whether a call has a result or a result a
    call; valid is about a call's arguments (null for others). Rows are ordered by
    (conv_id, position, depth, turn, kind, call_id).

    No row is lost: rows that repeat conv_id, turn, role and text are one whose ``copies`` say
    how many; of calls that repeat an identifier, and of results likewise, all but the first by
    turn are ``repeated``; calls without an identifier are unlinked; the content that stands
    beside tool calls is a message; rows without a conv_id or turn are messages. Null texts
    and roles are empty. Arguments that are no JSON are written as a string. Other columns are
    not read. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    if schemas is None:
        schemas = schema_table(spark, [(REPLY, "text", "string", True)])
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    turns = turns.withColumn("object", F.when(known & F.ltrim("text").startswith("{"), F.from_json("text", CALLS)))
    has_calls = F.coalesce(F.size("object.tool_calls") > 0, F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & F.col("object.tool_call_id").isNotNull(), F.lit(False))
    plain = turns.filter(~has_calls & ~is_result)
    # Identifiers that were given and those of turns are told apart.
    named = lambda c: F.concat(F.lit("id:"), c)
    at_turn = lambda c: F.concat(F.lit("turn-"), c.cast("string"))

    explicit = turns.filter(has_calls).select("conv_id", "turn", "role", "copies", F.when(is_result, named(F.col("object.tool_call_id"))).alias("parent"), F.posexplode("object.tool_calls").alias("ord", "c"))
    explicit = explicit.select("conv_id", "turn", "ord", "role", "copies", "parent", named(F.col("c.id")).alias("key"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"))
    asked = plain.filter(known & (F.col("role") == "user")).select("conv_id", "turn", F.lit(0).alias("ord"), "role", "copies", F.lit(None).cast("string").alias("parent"), at_turn(F.col("turn")).alias("key"), at_turn(F.col("turn")).alias("call_id"), F.lit(REPLY).alias("name"), _canonical(text=F.col("text")).alias("arguments"))
    calls = explicit.unionByName(asked)
    answered = turns.filter(is_result).select("conv_id", "turn", "role", "copies", named(F.col("object.tool_call_id")).alias("key"), F.col("object.tool_call_id").alias("call_id"), F.coalesce("object.content", F.lit("")).alias("content"))
    replies = plain.filter(known & (F.col("role") == "assistant")).select("conv_id", "turn", "role", "copies", at_turn(F.col("turn") - 1).alias("key"), at_turn(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    results = answered.unionByName(replies)

    call_order = F.struct("turn", "ord", F.sha2("arguments", 256), "name", "role")
    result_order = F.struct("turn", F.sha2("content", 256), "role")
    first_calls = calls.filter("key is not null").groupBy("conv_id", "key").agg(F.min(F.struct(call_order.alias("first"), "parent")).alias("x")).select("conv_id", "key", F.col("x.first").alias("first_call"), F.col("x.first.turn").alias("turn"), "x.parent")
    first_results = results.groupBy("conv_id", "key").agg(F.min(result_order).alias("first_result"))
    begins = _ordered(first_calls).join(first_calls.select("conv_id", "key", "first_call").hint("shuffle_hash"), ["conv_id", "key"])
    links = settle(begins.join(first_results.hint("shuffle_hash"), ["conv_id", "key"], "full"), "links")

    no = F.lit(False)
    own_calls = validated(calls, schemas).join(links.hint("shuffle_hash"), ["conv_id", "key"], "left")
    again = F.coalesce(call_order != F.col("first_call"), no)
    arguments = F.expr("coalesce(try_parse_json(arguments), cast(arguments as variant))")
    call_rows = own_calls.select(
        "conv_id", "turn", F.when(again, F.col("turn")).otherwise(F.coalesce("call_position", "turn")).alias("position"), F.when(again, 0).otherwise(F.coalesce("call_depth", F.lit(0))).alias("depth"),
        F.lit("call").alias("kind"), "call_id", F.col("first_result").isNotNull().alias("linked"), "valid", again.alias("repeated"), "copies",
        _canonical(arguments=arguments, id=F.col("call_id"), name=F.col("name"), role=F.col("role"), valid=F.col("valid")).alias("line"),
    )
    linked = F.col("call_position").isNotNull()
    result_rows = results.join(links.hint("shuffle_hash"), ["conv_id", "key"], "left").select(
        "conv_id", "turn", F.greatest("turn", F.coalesce("call_position", "turn")).alias("position"), F.when(F.col("call_position") >= F.col("turn"), F.col("call_depth") + 1).otherwise(0).alias("depth"),
        F.lit("result").alias("kind"), "call_id", linked.alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.coalesce(result_order != F.col("first_result"), no).alias("repeated"), "copies",
        _canonical(call_id=F.col("call_id"), content=F.col("content"), linked=linked, role=F.col("role")).alias("line"),
    )
    beside = turns.filter(has_calls & ~is_result & (F.coalesce("object.content", F.lit("")) != "")).withColumn("text", F.col("object.content"))
    others = plain.filter(~known | ~F.col("role").isin("user", "assistant")).unionByName(beside).select(
        "conv_id", "turn", F.col("turn").alias("position"), F.lit(0).alias("depth"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), no.alias("linked"), F.lit(None).cast("boolean").alias("valid"), no.alias("repeated"), "copies",
        _canonical(content=F.col("text"), role=F.col("role")).alias("line"),
    )
    return call_rows.unionByName(result_rows).unionByName(others)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``format_chats`` of all of ``conversations``; odd rows as stated there."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same over conversations without tool calls in their texts, as the tables have them.
OP9_SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL),
k AS (SELECT * FROM t WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT *, 'turn-' || turn AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256(to_json({'text': text})::VARCHAR)) > 1 AS repeated FROM k WHERE role = 'user'),
r AS (SELECT *, 'turn-' || (turn - 1) AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256(text)) > 1 AS repeated FROM k WHERE role = 'assistant'),
ca AS (SELECT DISTINCT conv_id, call_id FROM c), ra AS (SELECT DISTINCT conv_id, call_id FROM r)
SELECT c.conv_id, c.turn, c.turn AS position, 0 AS depth, 'call' AS kind, c.call_id, ra.conv_id IS NOT NULL AS linked, TRUE AS valid, repeated, copies,
       CAST(to_json({'arguments': {'text': c.text}, 'id': c.call_id, 'name': 'reply', 'role': c.role, 'valid': TRUE}) AS VARCHAR) AS line
FROM c LEFT JOIN ra USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.turn, r.turn, 0, 'result', r.call_id, ca.conv_id IS NOT NULL, NULL, repeated, copies,
       CAST(to_json({'call_id': r.call_id, 'content': r.text, 'linked': ca.conv_id IS NOT NULL, 'role': r.role}) AS VARCHAR)
FROM r LEFT JOIN ca USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, turn, 0, 'message', NULL, FALSE, NULL, FALSE, copies, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) FROM t
WHERE conv_id IS NULL OR turn IS NULL OR role NOT IN ('user', 'assistant')
"""
