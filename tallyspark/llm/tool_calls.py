"""Tool calls: linked to their results, ordered, validated and serialised, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import common

#: JSON types of a schema and how Spark's variant schemas begin.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def order_calls(calls: DataFrame) -> DataFrame:
    """(group_id, call_id, level): the most calls in a row that must come before a call, null on or behind a cycle.

    calls has (group_id, call_id, after), one row per identifier; after is the call it needs, or an array of them; null
    or unknown ones are none. Null identifiers take no part. Where every call needs one at most, each round doubles how
    far back all look, so a chain of n calls takes log2(n) rounds; else a round settles all calls whose needs are
    settled, so that there are as many rounds as levels. Every round is a join on (group_id, call_id): a group of any
    size is spread over all tasks.
    """
    calls = calls.where("group_id is not null and call_id is not null")
    needs = calls.select("group_id", "call_id", F.explode("after").alias("after")) if isinstance(calls.schema["after"].dataType, ArrayType) else calls.select("group_id", "call_id", "after")
    known = calls.select("group_id", F.col("call_id").alias("after"))
    needs = common.cut(needs.where("after is not null").join(known.hint("shuffle_hash"), ["group_id", "after"], "left_semi").distinct(), "needs")
    several = needs.groupBy("group_id", "call_id").count().where("count > 1").limit(1).count()
    return _layers(calls.select("group_id", "call_id"), needs) if several else _doubled(calls.select("group_id", "call_id"), needs)


def _layers(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """Levels of calls that may need several others, one round per level."""
    level, left = 0, common.cut(calls, "left")
    settled = calls.select("group_id", "call_id", F.lit(0).cast("long").alias("level")).limit(0)
    while True:
        open_ = needs.join(left.select("group_id", F.col("call_id").alias("after")).hint("shuffle_hash"), ["group_id", "after"], "left_semi")
        now = common.cut(left.join(open_.select("group_id", "call_id").distinct().hint("shuffle_hash"), ["group_id", "call_id"], "left_anti"), "now")
        if not now.limit(1).count():
            return settled.unionByName(left.select("group_id", "call_id", F.lit(None).cast("long").alias("level")))
        settled = settled.unionByName(now.select("group_id", "call_id", F.lit(level).cast("long").alias("level")))
        left = common.cut(left.join(now.hint("shuffle_hash"), ["group_id", "call_id"], "left_anti"), "left")
        level += 1


def _doubled(calls: DataFrame, needs: DataFrame) -> DataFrame:
    live = needs.select("group_id", "call_id", "after", F.lit(1).cast("long").alias("level"))
    start = calls.join(live.select("group_id", "call_id").hint("shuffle_hash"), ["group_id", "call_id"], "left_anti").select("group_id", "call_id", F.lit(None).cast("string").alias("after"), F.lit(0).cast("long").alias("level"))
    at = common.cut(start.unionByName(live), "order")
    rounds, most = 0, max(1, calls.count()).bit_length() + 1
    while rounds < most and at.where("after is not null").limit(1).count():
        open_ = at.where("after is not null")
        back = at.select("group_id", F.col("call_id").alias("after"), F.col("after").alias("before"), F.col("level").alias("more"))
        moved = open_.join(back.hint("shuffle_hash"), ["group_id", "after"]).select("group_id", "call_id", F.col("before").alias("after"), (F.col("level") + F.col("more")).alias("level"))
        at = common.cut(at.where("after is null").unionByName(moved), "order")
        rounds += 1
    return at.select("group_id", "call_id", F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def errors_of(arguments: Column, name: Column, schemas: dict) -> Column:
    """Why the arguments (a JSON text) don't fit the schema of the call's tool; an empty array if they do.

    schemas: {tool: {"required": [...], "properties": {field: type}, "additional": bool}}, types as in TYPES.
    """
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    found = F.array(F.when(value.isNull() & F.json_object_keys(arguments).isNotNull(), F.lit("repeated key")).when(value.isNull(), F.lit("not JSON")).when(~kind.rlike("^OBJECT"), F.lit("not an object")))
    by_tool = F.array(F.lit("unknown tool"))
    keys = F.json_object_keys(arguments)
    for tool, schema in schemas.items():
        checks = [F.when(~F.array_contains(keys, field), F.lit(f"{field}: missing")) for field in schema.get("required", [])]
        for field, want in schema.get("properties", {}).items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            checks.append(F.when(F.array_contains(keys, field) & ~got.rlike(f"^{TYPES[want]}"), F.lit(f"{field}: not {want}")))
        if not schema.get("additional", True):
            extra = F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))))
            checks.append(F.when(F.size(extra) > 0, F.concat(F.array_join(extra, ","), F.lit(": unknown"))))
        by_tool = F.when(name == tool, F.array(*checks) if checks else F.array(F.lit(None).cast("string"))).otherwise(by_tool)
    wrong = F.when(value.isNull() | ~kind.rlike("^OBJECT"), found).otherwise(by_tool)
    return F.array_compact(wrong)


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys, no white space, and each number in one form; null if it isn't JSON.

    Numbers that are whole and below 1e15 are written as integers, others as the shortest decimal that is the same double.
    """
    tokens = F.regexp_extract_all(json, F.lit(r'(?s)"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|.'), F.lit(0))

    def plain(token: Column) -> Column:
        value = token.try_cast("double")
        whole = (F.abs(value) < 1e15) & (value == F.floor(value))
        return F.when(token.rlike(r"^-?[0-9]") & ~token.rlike("^-?(0|[1-9][0-9]*)$") & value.isNotNull(), F.when(whole, F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))).when(token == "-0", "0").otherwise(token)

    valid = F.try_parse_json(json)
    return F.when(valid.isNotNull(), F.to_json(F.try_parse_json(F.array_join(F.transform(tokens, plain), ""))))


def _first(rows: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Of distinct rows (group_id, call_id, fields, copies) the least of each identifier, and the others with their copies;
    None where no identifier repeats. Contents are compared for repeated identifiers alone."""
    key = ["group_id", "call_id"]
    repeated = common.cut(rows.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*key), "repeated")
    n = repeated.count()
    if not n:
        return rows.drop("copies"), None
    few = common.maybe_broadcast(repeated, n)
    own, single = rows.join(few, key), rows.join(few, key, "left_anti")
    first = own.groupBy(*key).agg(F.min(F.struct(*fields)).alias("first__"))
    same = F.struct(*fields).eqNullSafe(F.col("first__"))
    more = own.join(first, key).withColumn("copies", F.when(same, F.col("copies") - 1).otherwise(F.col("copies"))).where("copies > 0").drop("first__")
    return single.drop("copies").unionByName(first.select(*key, "first__.*")), more


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """(group_id, call_id, name, after, level, status, errors, json, copies) of each call, and of each result without one.

    calls: (group_id, call_id, name, arguments, after); results: (group_id, call_id, content). Both are hash-joined on
    (group_id, call_id), after equal rows have been counted. Status is linked, unanswered, orphan (a result without
    call), or cycle. Where an identifier repeats, the least row by content counts; its other rows have the status
    duplicate, a row for each content with the number of its copies. Null group or call identifiers link with nothing:
    such calls are unanswered and such results orphans. Null and very long arguments and contents are values like
    others; other columns of calls and results are left out. Empty tables give no rows.
    """
    key, listed = ["group_id", "call_id"], isinstance(calls.schema["after"].dataType, ArrayType)
    own = calls.select(*key, "name", "arguments", F.to_json("after").alias("after") if listed else F.col("after"))
    keyed = common.cut(own.where("group_id is not null and call_id is not null").groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies")), "keyed")
    told = common.cut(results.select(*key, "content").where("group_id is not null and call_id is not null").groupBy(*key, "content").agg(F.count(F.lit(1)).alias("copies")), "told")
    one, more = _first(keyed, ("name", "arguments", "after"))
    answer, again = _first(told, ("content",))
    levels = order_calls(one.withColumn("after", F.from_json("after", "array<string>")) if listed else one)
    both = one.withColumn("called", F.lit(True)).join(levels.hint("shuffle_hash"), key, "left").join(answer.withColumn("answered", F.lit(True)).hint("shuffle_hash"), key, "full_outer").withColumn("copies", F.lit(1).cast("long"))
    rest = own.where("group_id is null or call_id is null").withColumns({"called": F.lit(True), "level": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    lost = results.select(*key, "content").where("group_id is null or call_id is null").withColumns({"answered": F.lit(True), "copies": F.lit(1).cast("long")})
    both = both.unionByName(rest, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    whole = both.withColumn("status", status)
    if more is not None:
        whole = whole.unionByName(more.withColumns({"called": F.lit(True), "status": F.lit("duplicate")}), allowMissingColumns=True)
    if again is not None:
        whole = whole.unionByName(again.withColumn("status", F.lit("duplicate")), allowMissingColumns=True)
    checked = whole.withColumn("errors", F.when(F.col("called"), errors_of(F.col("arguments"), F.col("name"), schemas)).otherwise(F.array().cast("array<string>")))
    return checked.select(*key, "name", "after", "level", "status", "errors", serialised().alias("json"), "copies")


def quoted(text: Column) -> Column:
    """A text as JSON; null as null."""
    listed = F.to_json(F.to_variant_object(F.array(text)))
    return F.coalesce(F.substring(listed, F.lit(2), F.length(listed) - 2), F.lit("null"))


def serialised() -> Column:
    parts = [("arguments", F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))), ("id", quoted(F.col("call_id"))), ("name", quoted(F.col("name"))), ("result", quoted(F.col("content")))]
    return F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(parts) for x in (F.lit(("," if i else "") + f'"{k}":'), v)), F.lit("}"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of chat turns (conv_id, turn, role, text), each turn of a user a call to the tool "reply" with
    identifier c<conversation>-<turn>, needing the call two turns before; an assistant's turn answers the turn before.
    Turns without a number have no identifier and link with nothing; other roles, and none, are in neither."""
    own = turns.select(F.col("conv_id").cast("long").alias("group_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda back: F.concat(F.lit("c"), F.col("group_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text")), {"ignoreNullFields": "false"})
    calls = own.where("role = 'user'").select("group_id", name(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), name(2).alias("after"))
    return calls, own.where("role = 'assistant'").select("group_id", name(1).alias("call_id"), F.col("text").alias("content"))


REPLY = {"reply": {"required": ["text", "turn"], "properties": {"text": "string", "turn": "integer"}, "additional": False}}


def link_conversations(turns: DataFrame) -> DataFrame:
    """link() of the calls and results of chat turns, the errors joined into a text; turns of other roles, or of none, are
    rows of the status message. Every turn is in a row, equal ones in one with the number of its copies."""
    calls, results = conversation_calls(turns)
    found = link(calls, results, REPLY).withColumn("errors", F.array_join("errors", "; "))
    other = turns.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    other = other.select(F.col("conv_id").cast("long").alias("group_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("call_id"), F.col("role").cast("string").alias("name"), F.col("text").cast("string").alias("content"))
    other = other.groupBy(*other.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("arguments", F.lit(None).cast("string"))
    other = other.select("group_id", "call_id", "name", F.lit("message").alias("status"), F.lit("").alias("errors"), serialised().alias("json"), "copies")
    return found.unionByName(other, allowMissingColumns=True).withColumnRenamed("group_id", "conv_id")
