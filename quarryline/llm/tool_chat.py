"""Chat formatting with linked tool calls, in DataFrame operations only.

Calls are written in a message's text as <tool_call>{"id", "name", "arguments", "after"}</tool_call>; a message of role
`tool` whose text is a JSON object with "tool_call_id" is a result. In a plain conversation, a user's turn is a call of
REPLY (its argument is the text) under the identifier of its turn, and the turn right after it, if the assistant's, is the
result. Calls and results are linked by hash joins on (conversation, identifier); of calls that share an identifier the
first one counts. Messages are ordered topologically: a message comes no earlier than its own turn, than the call it
answers and than the calls that its calls name in "after". Arguments are checked against a schema for each tool, and every
message is serialised as canonical JSON: keys in order, no white space.

No window or list is taken over a conversation, so one that holds a third of all rows is no bottleneck. Ordering relaxes
the dependencies once for each link of the longest chain, cutting the lineage each time; messages on a cycle keep their
turn and are marked. Defined results: null texts are empty, null roles and turns are left out of the JSON; rows without
conv_id form one conversation without a name, whose calls link to nothing; repeated rows stay, each linked alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop

REPLY = "reply"
#: Calls, results and places are unique by conversation and identifier, so each task's hash table is as small as its part.
HASH = "shuffle_hash"
_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
#: Names of variant types that satisfy a JSON Schema type.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


@dataclass(frozen=True)
class Parameter:
    kind: str
    required: bool = True
    min_length: int = 0


@dataclass(frozen=True)
class Tool:
    name: str
    parameters: dict[str, Parameter] = field(default_factory=dict)
    extra: bool = False


#: The one tool of plain conversations.
PLAIN = (Tool(REPLY, {"prompt": Parameter("string", True, 1)}),)


def _kind_ok(v: Column, path: str, kind: str) -> Column:
    name = F.regexp_extract(F.schema_of_variant(F.variant_get(v, path, "variant")), r"^[A-Z]+", 0)
    return name.isin(_KINDS[kind])


def argument_error(tools: tuple[Tool, ...], name: Column, arguments: Column) -> Column:
    """Null where the arguments (JSON text) fit the tool's schema; else what is wrong first."""
    v = F.try_parse_json(arguments)
    out = F.when(name.isNull(), F.lit("call without name"))
    for tool in tools:
        wrong = F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("arguments are no object"))
        for key, p in sorted(tool.parameters.items()):
            path = "$['" + key.replace("'", "\\'") + "']"
            there = F.variant_get(v, path, "variant").isNotNull()
            if p.required:
                wrong = wrong.when(~there, F.lit(f"{key}: missing"))
            wrong = wrong.when(there & ~_kind_ok(v, path, p.kind), F.lit(f"{key}: not {p.kind}"))
            if p.min_length:
                wrong = wrong.when(there & (F.length(F.try_variant_get(v, path, "string")) < p.min_length), F.lit(f"{key}: too short"))
        if not tool.extra:
            known = F.array(*[F.lit(k) for k in sorted(tool.parameters)]).cast("array<string>")
            wrong = wrong.when(F.size(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known)) > 0, F.lit("unknown argument"))
        out = out.when(name == tool.name, wrong)
    return out.otherwise(F.lit("unknown tool"))


def _events(messages: DataFrame) -> DataFrame:
    """Messages with their calls (id, name, args, after) and the identifier they answer."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn_id = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    m = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    blocks = F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))
    written = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.id").alias("id"), F.get_json_object(b, "$.name").alias("name"), F.coalesce(F.get_json_object(b, "$.arguments"), F.lit("{}")).alias("args"), F.coalesce(F.from_json(F.get_json_object(b, "$.after"), "array<string>"), F.array().cast("array<string>")).alias("after")))
    plain = F.array(F.struct(turn_id(F.col("turn")).alias("id"), F.lit(REPLY).alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("args"), F.array().cast("array<string>").alias("after")))
    none = F.filter(plain, lambda _: F.lit(False))
    has = F.col("text").contains("<tool_call>")
    m = m.withColumn("calls", F.when(has, written).when(F.col("role") == "user", plain).otherwise(none))
    answers = F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id")).when(F.col("role") == "assistant", turn_id(F.col("turn") - 1))
    return m.withColumn("answers", answers)


def link(messages: DataFrame, tools: tuple[Tool, ...] = PLAIN) -> DataFrame:
    """Per message: conv_id, turn, role, text, calls with their number of results and their errors, and the linked call."""
    events = _events(messages)
    calls = events.select("conv_id", "turn", F.inline("calls")).where(F.col("id").isNotNull() & F.col("conv_id").isNotNull())
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "name", "args")).alias("call"), F.count("*").alias("uses"))
    results = events.where(F.col("answers").isNotNull() & F.col("conv_id").isNotNull()).groupBy("conv_id", F.col("answers").alias("id")).agg(F.count("*").alias("n_results"))
    known = first.join(results.hint(HASH), ["conv_id", "id"], "left")
    target = known.select("conv_id", F.col("id").alias("answers"), F.col("call.name").alias("answered_name"), F.col("call.turn").alias("answered_turn"))
    return events.join(target.hint(HASH), ["conv_id", "answers"], "left"), known


def order(events: DataFrame, known: DataFrame) -> DataFrame:
    """Topological place (at_turn, level) of every call that waits for others, by relaxing along the `after` links. A round
    writes the calls that are still open once, with what they have met so far; those that met all they wait for are placed."""
    calls = events.select("conv_id", "turn", F.inline("calls")).where(F.col("id").isNotNull() & F.col("conv_id").isNotNull())
    names = known.select("conv_id", F.col("id").alias("on"))
    waits = checkpointed(calls.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("on")).join(names.hint(HASH), ["conv_id", "on"], "left_semi").distinct())
    place = known.select("conv_id", "id", F.col("call.turn").alias("at_turn"), F.lit(0).alias("level"))
    if waits.isEmpty():
        drop(waits)
        return place.withColumn("cyclic", F.lit(False))
    number = waits.groupBy("conv_id", "id").agg(F.count("*").alias("left"))
    met = F.struct(F.col("at_turn").alias("t"), F.lit(-1).alias("l"))
    state = checkpointed(place.join(number.hint(HASH), ["conv_id", "id"], "left").select("conv_id", "id", "at_turn", F.coalesce("left", F.lit(0)).alias("left"), met.alias("met")))
    # the latest of what a call waits for; its own turn, with no level yet, where that is later
    level = F.when((F.col("met.t") >= F.col("at_turn")) & (F.col("met.l") >= 0), F.col("met.l") + 1).otherwise(F.lit(0))
    placed = lambda s: s.where("left = 0").select("conv_id", "id", F.greatest("at_turn", "met.t").alias("at_turn"), level.alias("level"))
    done = [placed(state)]
    while not (now := done[-1]).isEmpty():
        step = waits.join(now.select("conv_id", F.col("id").alias("on"), F.struct(F.col("at_turn").alias("t"), F.col("level").alias("l")).alias("of")).hint(HASH), ["conv_id", "on"])
        step = step.groupBy("conv_id", "id").agg(F.count("*").alias("gone"), F.max("of").alias("of"))
        open_ = state.where("left > 0").join(step.hint(HASH), ["conv_id", "id"], "left")
        state = checkpointed(open_.select("conv_id", "id", "at_turn", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left"), F.greatest("met", "of").alias("met")))
        done.append(placed(state))
    out = state.where("left > 0").select("conv_id", "id", "at_turn", F.lit(0).alias("level"), F.lit(True).alias("cyclic"))
    for part in done:
        out = out.unionByName(part.withColumn("cyclic", F.lit(False)))
    return out


def format_chat(messages: DataFrame, tools: tuple[Tool, ...] = PLAIN) -> DataFrame:
    """conv_id, turn, role, at_turn and level (sort by both, then turn), n_calls, n_unanswered, n_invalid, linked, cyclic,
    and json: the message in canonical form."""
    events, known = link(messages, tools)
    places = order(events, known)
    own = events.withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    calls = own.select("conv_id", "row", "turn", F.posexplode("calls").alias("k", "c")).select("conv_id", "row", "k", "c.*")
    # repeated messages hold the same calls: each is looked up once
    calls = calls.groupBy("conv_id", "row", "k").agg(F.first("id").alias("id"), F.first("name").alias("name"), F.first("args").alias("args"))
    seen = calls.join(known.select("conv_id", "id", F.coalesce("n_results", F.lit(0)).alias("n_results")).hint(HASH), ["conv_id", "id"], "left").join(places.hint(HASH), ["conv_id", "id"], "left")
    error = argument_error(tools, F.col("name"), F.col("args"))
    canonical = F.to_json(F.try_parse_json("args"))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(canonical, F.lit("null")), F.lit(',"id":'), _text(F.col("id")), F.lit(',"name":'), _text(F.col("name")), F.lit("}"))
    seen = seen.withColumn("error", error)
    per = seen.groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("b")))), lambda x: x["b"]).alias("bodies"),
        F.count_if(F.coalesce("n_results", F.lit(0)) == 0).alias("n_unanswered"), F.count_if(F.col("error").isNotNull()).alias("n_invalid"), F.max(F.struct("at_turn", "level")).alias("p"), F.coalesce(F.bool_or("cyclic"), F.lit(False)).alias("cyclic"),
    )
    out = own.join(per.hint(HASH), "row", "left").join(places.select("conv_id", F.col("id").alias("answers"), F.col("at_turn").alias("a_turn"), F.col("level").alias("a_level")).hint(HASH), ["conv_id", "answers"], "left")
    later = F.greatest(F.struct(F.col("turn").alias("t"), F.lit(0).alias("l")), F.when(F.col("p").isNotNull(), F.struct(F.col("p.at_turn").alias("t"), F.col("p.level").alias("l"))), F.when(F.col("answered_name").isNotNull(), F.struct(F.col("a_turn").alias("t"), (F.col("a_level") + 1).alias("l"))))
    linked = F.col("answered_name").isNotNull()
    shown = F.when(F.size("calls") > 0, F.concat(F.lit('"calls":['), F.array_join("bodies", ","), F.lit("]")))
    said = F.concat(F.lit('"content":'), _text(F.trim(F.regexp_replace("text", _CALL, ""))))
    answer = F.when(linked, F.concat(F.lit('"result_of":'), _text(F.col("answers"))))
    role = F.concat(F.lit('"role":'), _text(F.col("role")))
    json = F.concat(F.lit("{"), F.concat_ws(",", shown, said, answer, role), F.lit("}"))
    return out.withColumn("later", later).select("conv_id", "turn", "role", F.col("later.t").alias("at_turn"), F.col("later.l").alias("level"), F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_unanswered", F.lit(0)).cast("long").alias("n_unanswered"), F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"), linked.alias("linked"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), json.alias("json"))


def _text(c: Column) -> Column:
    """A JSON string literal; null reads as null."""
    wrapped = F.to_json(F.struct(c.alias("a")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def report(conversations: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return format_chat(conversations)


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
c AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM m WHERE role = 'assistant')
SELECT m.conv_id, m.turn, m.role, m.turn AS at_turn, 0 AS level, CAST(role IS NOT DISTINCT FROM 'user' AS BIGINT) AS n_calls,
  CAST(role IS NOT DISTINCT FROM 'user' AND r.turn IS NULL AS BIGINT) AS n_unanswered, CAST(role IS NOT DISTINCT FROM 'user' AND t = '' AS BIGINT) AS n_invalid,
  c.turn IS NOT NULL AS linked, false AS cyclic,
  '{' || CASE WHEN role = 'user' THEN '"calls":[{"arguments":{"prompt":' || CAST(to_json(t) AS VARCHAR) || '},"id":"turn-' || m.turn || '","name":"reply"}],' ELSE '' END
  || '"content":' || CAST(to_json(trim(t)) AS VARCHAR) || CASE WHEN c.turn IS NOT NULL THEN ',"result_of":"turn-' || (m.turn - 1) || '"' ELSE '' END || coalesce(',"role":' || CAST(to_json(role) AS VARCHAR), ',"role":null') || '}' AS json
FROM m LEFT JOIN c ON m.role = 'assistant' AND c.conv_id = m.conv_id AND c.turn = m.turn - 1
LEFT JOIN r ON m.role = 'user' AND r.conv_id = m.conv_id AND r.turn = m.turn
"""
