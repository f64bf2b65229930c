"""Chat formatting: tool-call linking in DataFrame functions alone.

Calls and results are tables keyed by conversation and call identifier. They are hash-joined by that
key, put in topological order, the arguments are validated against the tool's schema, and each event is
serialised as canonical JSON (keys sorted, no blanks, numbers in their shortest form).

*Order.* A call may name the call whose result it needs (``needs``), and a result needs its call. ``step`` is the place of
an event in the order that follows: 2 x (length of its chain of needed calls) for a call, one more for its results. Chains
are followed by pointer doubling, so rounds grow with the logarithm of the longest chain; each is a hash join by
(conversation, call), so no conversation is ever gathered or windowed, whatever its length. ``after_turn`` orders events of
one step. Sorting by (conv_id, step, after_turn, kind, turn) gives a topological order.

*Hot keys.* The first call and the number of results of a key are map-side aggregates.

Defined results: of several calls with one identifier the one of the smallest turn (then text) is linked,
the others are ``duplicate``; a call without a result is ``pending``, a result without a call is
``orphan``, and so are those with a null identifier; equal rows stay as often as they come; arguments that
are null or no JSON object are invalid, and kept as a JSON string where they do not parse; a tool without a schema is
invalid, and a schema with a keyword that is not checked is refused; a needed call that is not there is ignored; calls in
or behind a circle of needs are ``cyclic`` and, like orphans and rows without an identifier, have no step; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: Variant type names that a JSON schema type stands for.
KINDS = {"string": r"STRING", "integer": r"BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL.*)", "boolean": r"BOOLEAN", "array": r"ARRAY.*", "object": r"OBJECT.*"}


#: Keywords that are checked, of an object and of its properties.
OBJECT, PROPERTY = {"type", "properties", "required", "additionalProperties"}, {"type", "minLength", "maxLength", "minimum", "maximum", "enum", "pattern"}


def _checked(schema: dict) -> None:
    odd = (set(schema) - OBJECT) | {k for rule in schema.get("properties", {}).values() for k in set(rule) - PROPERTY}
    if odd or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"schema keywords that are not supported: {sorted(odd) or ['additionalProperties']}")


def _problem(arguments: Column, schema: dict) -> Column:
    """The first thing wrong with JSON arguments under an object schema, or null."""
    _checked(schema)
    value = F.try_parse_json(arguments)
    names = sorted(schema.get("properties", {}))
    cases = [(F.coalesce(~F.schema_of_variant(value).rlike(r"\AOBJECT"), F.lit(True)), "no object")]
    for name in schema.get("required", []):
        cases.append((~F.array_contains(F.json_object_keys(arguments), name), f"{name} is missing"))
    if not schema.get("additionalProperties", True):
        extra = F.filter(F.json_object_keys(arguments), lambda k: ~k.isin(*names))
        cases.append((F.size(extra) > 0, "unknown property"))
    for name in names:
        rule = schema["properties"][name]
        part = F.try_variant_get(value, f"$['{name}']", "variant")
        cases.append((~F.schema_of_variant(part).rlike(rf"\A{KINDS[rule['type']]}\z"), f"{name} is no {rule['type']}"))
        text = F.try_variant_get(value, f"$['{name}']", "string")
        number = F.try_variant_get(value, f"$['{name}']", "double")
        for key, test in (("minLength", lambda n, t=text: F.length(t) < n), ("maxLength", lambda n, t=text: F.length(t) > n), ("minimum", lambda n, v=number: v < n), ("maximum", lambda n, v=number: v > n)):
            if key in rule:
                cases.append((test(rule[key]), f"{name} breaks {key}"))
        if "enum" in rule:
            cases.append((part.isNotNull() & ~F.coalesce(text.isin(*[str(v) for v in rule["enum"]]), F.lit(False)), f"{name} breaks enum"))
        if "pattern" in rule:
            cases.append((~text.rlike(rule["pattern"]), f"{name} breaks pattern"))
    out = F.lit(None).cast("string")
    for test, message in reversed(cases):
        out = F.when(test, message).otherwise(out)
    return out


def problem(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    out = F.lit("unknown tool")
    for tool, schema in sorted(schemas.items()):
        out = F.when(name == tool, _problem(arguments, schema)).otherwise(out)
    return out


def levels(first: DataFrame) -> DataFrame:
    """(l_conv, l_call, level) of calls (conv_id, call_id, needs): how many calls stand before each on its chain.

    Pointers double each round: a call knows the call 1, 2, 4, ... places before it. Those whose pointer has not come
    to a start after as many rounds as there are bits in the number of calls are cyclic and have no level.
    """
    where = shared_dir(first.sparkSession)
    there = first.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"))
    start = first.join(there.hint("shuffle_hash"), (F.col("conv_id") == F.col("p_conv")) & (F.col("needs") == F.col("p_call")), "left")
    nodes = stored(start.select("conv_id", "call_id", F.col("p_call").alias("jump"), F.col("p_call").isNotNull().cast("long").alias("level")), f"{where}/0")
    for k in range(nodes.count().bit_length() + 1):
        if nodes.filter("jump is not null").isEmpty():
            break
        ahead = nodes.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.col("jump").alias("p_jump"), F.col("level").alias("p_level"))
        met = nodes.join(ahead.hint("shuffle_hash"), (F.col("conv_id") == F.col("p_conv")) & (F.col("jump") == F.col("p_call")), "left")
        nodes = stored(met.select("conv_id", "call_id", F.col("p_jump").alias("jump"), (F.col("level") + F.coalesce("p_level", F.lit(0))).alias("level")), f"{where}/{k + 1}")
    return nodes.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Events of calls (conv_id, call_id, turn, name, arguments, needs) and results (conv_id, call_id, turn, content); ``needs`` may be missing."""
    key = ["conv_id", "call_id"]
    if "needs" not in calls.columns:
        calls = calls.withColumn("needs", F.lit(None).cast("string"))
    calls, results = calls.select(*key, "turn", "name", "arguments", "needs"), results.select(*key, "turn", "content")
    best = calls.groupBy(*key).agg(F.min(F.struct("turn", "arguments", "needs")).alias("f"))
    first = best.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call"), F.col("f.turn").alias("call_turn"), F.col("f.arguments").alias("f_arguments"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    steps = levels(best.filter(known).select("conv_id", "call_id", F.col("f.needs").alias("needs")))
    first = first.join(steps.hint("shuffle_hash"), (F.col("f_conv") == F.col("l_conv")) & (F.col("f_call") == F.col("l_call")), "left").drop("l_conv", "l_call")
    counts = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n_results")).withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_call"})
    mine = (F.col("conv_id") == F.col("f_conv")) & (F.col("call_id") == F.col("f_call"))
    asked = (
        calls.join(first.hint("shuffle_hash"), mine, "left")
        .join(counts.hint("shuffle_hash"), (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left")
    )
    is_first = F.col("turn").eqNullSafe(F.col("call_turn")) & F.col("arguments").eqNullSafe(F.col("f_arguments"))
    cyclic = F.col("f_conv").isNotNull() & F.col("level").isNull()
    wrong = problem(F.col("name"), F.col("arguments"), schemas)
    called = asked.select(
        *key, "turn", F.lit("call").alias("kind"), (2 * F.col("level")).alias("step"), F.col("turn").alias("after_turn"),
        F.when(F.col("f_conv").isNotNull() & ~is_first, "duplicate").when(cyclic, "cyclic").when(F.col("n_results") > 0, "linked").otherwise("pending").alias("status"),
        wrong.alias("problem"),
        F.to_json(
            F.struct(F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), F.col("call_id"), F.col("conv_id"), F.lit("call").alias("kind"), F.col("name"), F.col("turn")),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    answered = results.join(first.hint("shuffle_hash"), mine, "left").select(
        *key, "turn", F.lit("result").alias("kind"), (2 * F.col("level") + 1).alias("step"), F.greatest("turn", "call_turn").alias("after_turn"),
        F.when(cyclic, "cyclic").when(F.col("f_conv").isNotNull(), "linked").otherwise("orphan").alias("status"),
        F.lit(None).cast("string").alias("problem"),
        F.to_json(F.struct(F.col("call_id"), F.col("content"), F.col("conv_id"), F.lit("result").alias("kind"), F.col("turn")), {"ignoreNullFields": "false"}).alias("json"),
    )
    return called.unionByName(answered)


_PROPERTIES = {"after": {"type": "string", "pattern": "^call-"}, "turn": {"type": "integer", "minimum": 0}}
_SHAPE = {"type": "object", "required": ["prompt", "role", "turn"], "additionalProperties": False}
#: The exchanges of ``conversations`` as calls of two tools.
SCHEMAS = {
    "instruct": _SHAPE | {"properties": _PROPERTIES | {"prompt": {"type": "string", "minLength": 1}, "role": {"type": "string", "enum": ["system"]}}},
    "reply": _SHAPE | {"properties": _PROPERTIES | {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "role": {"type": "string"}}},
}


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of systems are calls of ``instruct``, those of users of ``reply``; an assistant's turn is the result of the turn before.

    A call needs the one two turns before it, the second turn's the first. A user's turn of several lines asks twice,
    the second time with arguments that break off; an assistant's gives its first line to the turn after it as well.
    """
    of_turn = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, lines = F.col("turn"), F.split(F.col("text"), "\n")
    asks = conversations.filter("role <> 'assistant' or role is null")
    asks = asks.withColumn("needs", F.when(turn >= 2, of_turn(turn - 2)).when(turn == 1, of_turn(turn - 1)))
    arguments = F.to_json(F.struct(turn, F.col("role"), F.col("text").alias("prompt"), F.col("needs").alias("after")))
    name = F.when(F.col("role") == "system", "instruct").otherwise("reply")
    broken = F.when((F.size(lines) > 1) & name.eqNullSafe(F.lit("reply")), F.concat(F.lit("{"), F.substring("text", 1, 20)))
    calls = asks.select("conv_id", of_turn(turn).alias("call_id"), "turn", name.alias("name"), F.explode(F.array_compact(F.array(arguments, broken))).alias("arguments"), "needs")
    given = conversations.filter("role = 'assistant'")
    early = F.when(F.size(lines) > 1, F.struct((turn + 1).alias("of"), lines[0].alias("content")))
    results = given.select("conv_id", "turn", F.explode(F.array_compact(F.array(F.struct((turn - 1).alias("of"), F.col("text").alias("content")), early))).alias("r"))
    return calls, results.select("conv_id", of_turn(F.col("r.of")).alias("call_id"), "turn", F.col("r.content").alias("content"))


def op2_chat_format(spark, sf_dir):
    return link(*exchanges(table(spark, sf_dir, "conversations")), SCHEMAS)


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {
    "op2_chat_format": """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, 'call-' || conv_id || '-' AS stem FROM conversations),
q AS (SELECT *, stem || turn AS call_id, CASE WHEN turn >= 2 THEN stem || (turn - 2) WHEN turn = 1 THEN stem || 0 END AS needs,
    CASE WHEN role = 'system' THEN 'instruct' ELSE 'reply' END AS name FROM c WHERE role <> 'assistant'),
a AS (SELECT *, false AS again, CASE WHEN text = '' THEN 'prompt breaks minLength' WHEN name = 'reply' AND length(text) > 400 THEN 'prompt breaks maxLength' END AS problem,
    '{' || coalesce('"after":' || to_json(needs) || ',', '') || '"prompt":' || to_json(text) || ',"role":' || to_json(role) || ',"turn":' || turn || '}' AS arguments FROM q
    UNION ALL SELECT *, true, 'no object', to_json('{' || substring(text, 1, 20)) FROM q WHERE name = 'reply' AND contains(text, chr(10))),
r AS (SELECT conv_id, turn, stem || (turn - 1) AS call_id, text AS content FROM c WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn, stem || (turn + 1), string_split(text, chr(10))[1] FROM c WHERE role = 'assistant' AND contains(text, chr(10))),
lev AS (SELECT conv_id, call_id, 0 AS level FROM q WHERE needs IS NULL OR needs NOT IN (SELECT call_id FROM q)
    UNION ALL SELECT q.conv_id, q.call_id, lev.level + 1 FROM q JOIN lev ON q.needs = lev.call_id)
SELECT a.conv_id, a.call_id, a.turn, 'call' AS kind, CAST(2 * level AS BIGINT) AS step, a.turn AS after_turn,
    CASE WHEN again THEN 'duplicate' WHEN a.call_id IN (SELECT call_id FROM r) THEN 'linked' ELSE 'pending' END AS status, problem,
    '{"arguments":' || arguments || ',"call_id":' || to_json(a.call_id) || ',"conv_id":' || a.conv_id || ',"kind":"call","name":"' || name || '","turn":' || a.turn || '}' AS json
FROM a JOIN lev ON a.call_id = lev.call_id
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, 'result', CAST(2 * level + 1 AS BIGINT), greatest(r.turn, q.turn), CASE WHEN q.call_id IS NULL THEN 'orphan' ELSE 'linked' END, NULL,
    '{"call_id":' || to_json(r.call_id) || ',"content":' || to_json(content) || ',"conv_id":' || r.conv_id || ',"kind":"result","turn":' || r.turn || '}'
FROM r LEFT JOIN q ON r.call_id = q.call_id LEFT JOIN lev ON r.call_id = lev.call_id"""
}
