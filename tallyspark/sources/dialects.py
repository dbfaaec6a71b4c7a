"""Log dialects: each a function from records (path, line, modified, value) to rows of usage.

``records`` come from logs.lines() (a row per line), documents() (a row per file) or sqlite.rows(); a dialect looks at
nothing but these columns, so any source that has them will do. What can't be read is left out, record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import hierarchy, precedence
from .logs import USAGE, get, number, parsed, time_ms

def record() -> Column:
    return F.col("doc")


def text(path: str, of: Column | None = None) -> Column:
    """A text, trimmed; null where it is empty."""
    return F.nullif(F.trim(get(record() if of is None else of, path, "string")), F.lit(""))


def dollars(path: str) -> Column:
    """A finite amount, as number or text; null otherwise, and where it is negative."""
    found = F.coalesce(get(record(), path, "double"), get(record(), path, "string").try_cast("double"))
    return F.when((found >= 0) & (found < float("inf")), found)


def items(records: DataFrame, path: str, doc: str = "doc") -> DataFrame:
    """A row per item of an array, with its place (index); the item becomes doc, what held it whole."""
    own = records.withColumn("whole", F.col(doc))
    return own.select("*", F.posexplode(F.try_variant_get(F.col("whole"), path, "array<variant>")).alias("index", "item")).drop(doc).withColumnRenamed("item", doc)


def entries(records: DataFrame, path: str) -> DataFrame:
    """A row per field of an object: name and doc, what held it whole."""
    own = records.withColumnRenamed("doc", "whole")
    return own.select("*", F.explode(F.try_variant_get(F.col("whole"), path, "map<string,variant>")).alias("name", "doc"))


def segment(back: int) -> Column:
    """A path's segment, counted from its end: 0 is the file."""
    return F.element_at(F.split("path", "/"), -1 - back)


def file_stem() -> Column:
    return F.regexp_replace(segment(0), r"\.[^.]*$", "")


def in_file():
    return Window.partitionBy("path").orderBy("line")


def known_before(value: Column) -> Column:
    """The last value that isn't null up to a record of its file."""
    return F.last(value, ignorenulls=True).over(in_file().rowsBetween(Window.unboundedPreceding, 0))


def known_first(value: Column) -> Column:
    return F.first(value, ignorenulls=True).over(in_file().rowsBetween(Window.unboundedPreceding, 0))


def workspace_key(path: Column) -> Column:
    """Forward slashes, none repeated (but two at the start) and none at the end; null where nothing is left."""
    x = F.regexp_replace(F.trim(path), r"\\", "/")
    lead = F.when(x.startswith("//"), "//").when(x.startswith("/"), "/").otherwise("")
    inner = F.regexp_replace(F.regexp_replace(x, "/+", "/"), "^/|/$", "")
    return F.nullif(F.concat(lead, inner), F.lit(""))


def provider_of(model: Column, otherwise: str, stated: Column | None = None) -> Column:
    """What the record states, in one spelling, else what the model's name shows, else the client's own."""
    rest = [names.provider_infer(model), F.lit(otherwise)]
    return F.coalesce(*([names.provider_canonical(stated)] if stated is not None else []), *rest)


BUCKETS = ("input", "output", "cache_read", "cache_write", "reasoning")


def rows(records: DataFrame, client: str | Column, /, used: bool = True, **columns: Column) -> DataFrame:
    """Rows of usage; with used, those without any token are left out. Times default to the file's own."""
    zero = F.lit(0).cast("long")
    defaults = {c: zero for c in BUCKETS} | {"message_count": F.lit(1), "is_turn_start": F.lit(False), "ts_ms": F.col("modified"), "cost_source": F.lit("unknown")}
    found = defaults | columns | {"client": F.lit(client) if isinstance(client, str) else client, "path": F.col("path"), "line": F.col("line")}
    fields = [x.strip().split(" ") for x in USAGE.split(",")]
    out = records.select(*((found[n] if n in found else F.lit(None)).cast(t).alias(n) for n, t in fields))
    return out.where(" or ".join(f"{c} > 0" for c in BUCKETS)) if used else out


def anchored(end: Column, duration: Column) -> Column:
    """When a request began that ended then, if that is after the epoch."""
    return F.when((duration > 0) & (end > duration), end - duration).otherwise(end)


def or_file_time(ms: Column) -> Column:
    return F.when(ms > 0, ms).otherwise(F.col("modified"))


# Lines of JSON -------------------------------------------------------------------------------------------------------


def qwen(records: DataFrame) -> DataFrame:
    """Counts as reported: cached tokens aren't taken out of the prompt's. Keys number a file's rows."""
    own = parsed(records).where((get(record(), "$.type", "string") == "assistant") & get(record(), "$.usageMetadata", "variant").isNotNull())
    u = "$.usageMetadata."
    session = F.coalesce(F.nullif(get(record(), "$.sessionId", "string"), F.lit("")), F.concat(segment(2), F.lit("-"), file_stem()))
    found = rows(
        own, "qwen", provider=F.lit("qwen"), model=F.coalesce(get(record(), "$.model", "string"), F.lit("unknown")), session_id=session, ts_ms=or_file_time(time_ms(record(), "$.timestamp")),
        workspace=F.nullif(F.regexp_extract("path", r"projects/([^/]+)/chats/[^/]*$", 1), F.lit("")),
        input=number(record(), u + "promptTokenCount"), output=number(record(), u + "candidatesTokenCount"), reasoning=number(record(), u + "thoughtsTokenCount"), cache_read=number(record(), u + "cachedContentTokenCount"),
    )
    return found.withColumn("dedup_key", F.concat_ws(":", F.lit("qwen"), "session_id", (F.row_number().over(in_file()) - 1).cast("string")))


def reasonix(records: DataFrame) -> DataFrame:
    """Statistics of requests: a miss count that isn't 0 is the input, else the prompt less the hits. Turn summaries go."""
    own = parsed(records.withColumn("place", F.row_number().over(in_file()) - 1))
    model, requests, total = text("$.model"), number(record(), "$.requests"), number(record(), "$.total")
    own = own.where(model.isNotNull() & ~F.coalesce(get(record(), "$.turn", "boolean"), F.lit(False)) & ((total > 0) | (requests > 0)) & (time_ms(record(), "$.ts") > 0))
    named = F.locate("/", model) > 0
    prefix = F.when(named, F.substring_index(model, "/", 1))
    hits, misses, done = number(record(), "$.cache_hit"), F.coalesce(get(record(), "$.cache_miss", "long"), F.lit(0)), number(record(), "$.completion")
    thought = F.least(number(record(), "$.reasoning"), done)
    return rows(
        own, "reasonix", False, provider=F.when(named, F.coalesce(names.provider_canonical(prefix), prefix)).otherwise(provider_of(model, "reasonix")), model=F.when(named, F.regexp_replace(model, "^[^/]*/", "")).otherwise(model),
        session_id=F.concat(F.lit("reasonix-stats:"), "path"), ts_ms=time_ms(record(), "$.ts"), input=F.when(misses != 0, F.greatest(misses, F.lit(0))).otherwise(F.greatest(number(record(), "$.prompt") - hits, F.lit(0))),
        output=done - thought, reasoning=thought, cache_read=hits, message_count=F.greatest(F.least(requests, F.lit(2147483647)), F.lit(1)),
        dedup_key=F.concat_ws(":", F.lit("reasonix"), "path", F.col("place").cast("string"), requests.cast("string"), total.cast("string")),
    )


def junie(records: DataFrame) -> DataFrame:
    """A row per model of a response's usage. A reported cost counts, of 0 too; the first row after a prompt starts a turn."""
    kind = F.when(get(record(), "$.kind", "string") == "UserPromptEvent", "prompt").when(get(record(), "$.event.agentEvent.kind", "string") == "LlmResponseMetadataEvent", "usage")
    own = parsed(records).withColumn("kind", kind).where("kind is not null")
    own = own.withColumn("after_prompt", F.lag("kind").over(in_file()) == "prompt").where("kind = 'usage'")
    own = own.withColumn("said", time_ms(record(), "$.timestampMs")).withColumn("agent", F.coalesce(text("$.event.agentEvent.agent.name"), text("$.event.agentEvent.agent.id")))
    own = items(own, "$.event.agentEvent.modelUsage").where(text("$.model").isNotNull())
    from_name = F.unix_millis(F.try_to_timestamp(F.regexp_extract(segment(1), r"^session-(\d{6}-\d{6})", 1), F.lit("yyMMdd-HHmmss")))
    ended, took, cost = F.when(F.col("said") > 0, F.col("said")), number(record(), "$.time"), dollars("$.cost")
    found = rows(
        own.withColumn("first", F.col("after_prompt") & (F.row_number().over(Window.partitionBy("path", "line").orderBy("index")) == 1)), "junie", False,
        model=text("$.model"), provider=provider_of(text("$.model"), "junie", text("$.provider")), session_id=segment(1), ts_ms=F.coalesce(anchored(ended, took), from_name, F.col("modified")),
        input=number(record(), "$.inputTokens", "$.input"), output=number(record(), "$.outputTokens", "$.output"), cache_read=number(record(), "$.cacheInputTokens", "$.cacheReadInputTokens", "$.cacheRead"),
        cache_write=number(record(), "$.cacheCreateTokens", "$.cacheCreationInputTokens", "$.cacheWrite"), reasoning=number(record(), "$.reasoningTokens", "$.reasoningOutputTokens", "$.thinkingTokens"),
        cost=F.coalesce(cost, F.lit(0.0)), cost_source=F.when(cost.isNotNull(), "reported").otherwise("unknown"), agent=F.col("agent"), duration_ms=F.when(took > 0, took), is_turn_start=F.coalesce(F.col("first"), F.lit(False)),
        dedup_key=F.concat_ws(":", F.lit("junie"), segment(1), F.coalesce(ended, from_name, F.col("modified")).cast("string"), text("$.model"), F.col("index").cast("string")),
    )
    found = found.where("input + output + cache_read + cache_write + reasoning > 0 or cost > 0")
    key = F.concat_ws(":", "dedup_key", *(F.col(c).cast("string") for c in BUCKETS), F.format_string("%.12f", "cost"))
    found = found.withColumn("dedup_key", key)
    return found.withColumn("n__", F.row_number().over(Window.partitionBy("path", "dedup_key").orderBy("line"))).where("n__ = 1").drop("n__")


def gjc(records: DataFrame) -> DataFrame:
    """Messages below a session's header; a cost in the record is reported, of 0 too."""
    kind = get(record(), "$.type", "string")
    own = parsed(records).withColumn("kind", kind).where("kind in ('session', 'message')")
    own = own.withColumn("session", known_before(F.when(F.col("kind") == "session", get(record(), "$.id", "string")))).withColumn("home", known_before(F.when(F.col("kind") == "session", workspace_key(get(record(), "$.cwd", "string")))))
    own = own.where((F.col("kind") == "message") & (get(record(), "$.message.role", "string") == "assistant") & get(record(), "$.message.usage", "variant").isNotNull() & get(record(), "$.message.model", "string").isNotNull())
    u, cost, model = "$.message.usage.", dollars("$.message.usage.cost.total"), get(record(), "$.message.model", "string")
    session = F.coalesce("session", file_stem())
    said = F.coalesce(get(record(), "$.message.timestamp", "long"), F.nullif(time_ms(record(), "$.timestamp"), F.lit(0).cast("long")), F.col("modified"))
    provider = F.coalesce(F.nullif(get(record(), "$.message.provider", "string"), F.lit("")), provider_of(model, "gjc"))
    return rows(
        own, F.coalesce(text("$.message.source"), F.lit("gjc")), False, model=model, provider=provider, session_id=session, workspace=F.col("home"), ts_ms=said,
        input=number(record(), u + "input"), output=number(record(), u + "output"), cache_read=number(record(), u + "cacheRead"), cache_write=number(record(), u + "cacheWrite"),
        cost=F.coalesce(cost, F.lit(0.0)), cost_source=F.when(cost.isNotNull(), "reported").otherwise("unknown"),
        dedup_key=F.concat_ws(":", session, F.coalesce(F.nullif(get(record(), "$.id", "string"), F.lit("")), F.sha2(F.trim("value"), 256))),
    )


def opencodereview(records: DataFrame) -> DataFrame:
    """Responses, each once by time, model and counts; without a time of their own also by their line."""
    kind = get(record(), "$.type", "string")
    own = parsed(records.withColumn("place", F.row_number().over(in_file()) - 1)).withColumn("kind", kind)
    own = own.withColumn("home", known_first(F.when(F.col("kind") == "session_start", get(record(), "$.cwd", "string")))).where("kind = 'llm_response'")
    said, took = F.nullif(time_ms(record(), "$.timestamp"), F.lit(0).cast("long")), F.coalesce(get(record(), "$.duration_ms", "long"), F.lit(0))
    model, u = F.coalesce(get(record(), "$.model", "string"), F.lit("unknown")), "$.usage."
    found = rows(
        own, "opencodereview", model=model, provider=provider_of(model, "opencodereview"), session_id=file_stem(), workspace=workspace_key(F.col("home")), ts_ms=F.coalesce(anchored(said, took), F.col("modified")),
        input=number(record(), u + "prompt_tokens"), output=number(record(), u + "completion_tokens"), cache_read=number(record(), u + "cache_read_tokens"), cache_write=number(record(), u + "cache_write_tokens"), duration_ms=F.when(took > 0, took),
        dedup_key=F.concat_ws(":", F.lit("opencodereview"), file_stem(), F.coalesce(said, F.col("modified")).cast("string"), model, *(number(record(), u + k).cast("string") for k in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens")), F.when(said.isNull(), F.concat(F.lit("line"), F.col("place").cast("string")))),
    )
    return found.withColumn("n__", F.row_number().over(Window.partitionBy("path", "dedup_key").orderBy("line"))).where("n__ = 1").drop("n__")


def antigravity(records: DataFrame) -> DataFrame:
    own = parsed(records).withColumn("kind", get(record(), "$.type", "string"))
    own = own.withColumn("meta", known_before(F.when(F.col("kind") == "session_meta", text("$.modelId")))).where("kind = 'usage'")
    own = own.where(get(record(), "$.sessionId", "string").isNotNull() & (number(record(), "$.timestamp") > 0))
    model = F.coalesce(text("$.modelId"), F.col("meta"), F.lit("unknown"))
    stated = text("$.providerId")
    return rows(
        own, "antigravity", model=model, provider=F.coalesce(names.provider_canonical(stated), stated, provider_of(model, "antigravity")), session_id=get(record(), "$.sessionId", "string"), ts_ms=number(record(), "$.timestamp"),
        input=number(record(), "$.input"), output=number(record(), "$.output"), cache_read=number(record(), "$.cacheRead"), cache_write=number(record(), "$.cacheWrite"), reasoning=number(record(), "$.reasoning"), dedup_key=text("$.responseId"),
    )


def pi_family(records: DataFrame, client: str = "pi") -> DataFrame:
    """Assistants' messages below a header; reasoning is part of the output and isn't told apart."""
    own = parsed(records).withColumn("kind", get(record(), "$.type", "string"))
    own = own.withColumn("session", known_before(F.when(F.col("kind") == "session", get(record(), "$.id", "string")))).withColumn("home", known_before(F.when(F.col("kind") == "session", workspace_key(get(record(), "$.cwd", "string")))))
    own = own.where((F.col("kind") == "message") & (get(record(), "$.message.role", "string") == "assistant") & get(record(), "$.message.usage", "variant").isNotNull())
    model, u = get(record(), "$.message.model", "string"), "$.message.usage."
    return rows(
        own.where(model.isNotNull()), client, model=model, provider=F.coalesce(text("$.message.provider"), provider_of(model, client)), session_id=F.coalesce("session", file_stem()), workspace=F.col("home"), ts_ms=or_file_time(time_ms(record(), "$.timestamp")),
        input=number(record(), u + "input"), output=number(record(), u + "output"), cache_read=number(record(), u + "cacheRead"), cache_write=number(record(), u + "cacheWrite"), dedup_key=get(record(), "$.id", "string"),
    )


def senpi(records: DataFrame) -> DataFrame:
    return pi_family(records, "senpi")


def kimchi(records: DataFrame) -> DataFrame:
    return pi_family(records, "kimchi")


def openclaw(records: DataFrame) -> DataFrame:
    """Messages with the model and provider that were named last, by a change, a snapshot or a message before."""
    own = parsed(records).withColumn("kind", get(record(), "$.type", "string"))
    snapshot = (F.col("kind") == "custom") & (get(record(), "$.customType", "string") == "model-snapshot")
    reply = (F.col("kind") == "message") & (get(record(), "$.message.role", "string") == "assistant") & get(record(), "$.message.usage", "variant").isNotNull()
    said = lambda k: F.when(F.col("kind") == "model_change", get(record(), f"$.{k}", "string")).when(snapshot, get(record(), f"$.data.{k}", "string"))
    full = lambda p: F.nullif(get(record(), p, "string"), F.lit(""))
    own = own.withColumn("model", known_before(F.nullif(F.coalesce(said("modelId"), F.when(reply, full("$.message.model"))), F.lit("")))).withColumn("provider", known_before(F.nullif(F.coalesce(said("provider"), F.when(reply, full("$.message.provider"))), F.lit(""))))
    u = "$.message.usage."
    return rows(
        own.where(reply & F.col("model").isNotNull()), "openclaw", False, model=F.col("model"), provider=F.coalesce("provider", F.lit("unknown")), session_id=F.substring_index(segment(0), ".jsonl", 1), ts_ms=F.coalesce(get(record(), "$.message.timestamp", "long"), F.col("modified")),
        input=number(record(), u + "input"), output=number(record(), u + "output"), cache_read=number(record(), u + "cacheRead"), cache_write=number(record(), u + "cacheWrite"), cost=F.coalesce(dollars(u + "cost.total"), F.lit(0.0)),
    )


def commandcode(records: DataFrame) -> DataFrame:
    """Tokens guessed at four characters each: what came since the last answer is input, the answer is output.

    The model stands in config.json two folders above; the first answer after a user's words starts a turn.
    """
    root = F.regexp_replace("path", r"/[^/]*/[^/]*/[^/]*$", "")
    config = parsed(records.where(segment(0) == "config.json")).select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), text("$.model").alias("raw"))
    own = parsed(records.where(F.col("path").endswith(".jsonl") & ~F.col("path").endswith(".checkpoints.jsonl"))).withColumn("role", get(record(), "$.role", "string"))
    body = F.to_json(get(record(), "$.content", "variant"))
    chars = F.when(body.isNull() | body.isin('""', "[]", "{}", "null"), 0).otherwise(F.length(body))
    own = own.withColumn("chars", chars).withColumn("answer", F.coalesce(F.col("role") == "assistant", F.lit(False))).withColumn("session", known_first(F.nullif(get(record(), "$.sessionId", "string"), F.lit(""))))
    own = own.withColumn("part", F.coalesce(F.sum(F.col("answer").cast("int")).over(in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = Window.partitionBy("path", "part")
    own = own.withColumn("heard", F.sum(F.when(~F.col("answer"), F.col("chars")).otherwise(0)).over(part)).withColumn("asked", F.max((F.col("role") == "user").cast("int")).over(part) == 1)
    own = own.where("answer").withColumn("root", root).join(config, "root", "left")
    guess = lambda n: F.ceil(F.col(n) / F.lit(4)).cast("long")
    model = F.regexp_replace(F.element_at(F.split("raw", "/"), -1), "(?i)(?<=.)-free$", "")
    found = rows(
        own, "commandcode", model=F.coalesce(model, F.lit("unknown")), provider=F.coalesce(names.provider_infer(F.col("raw")), F.lit("command-code")), session_id=F.coalesce("session", file_stem()), ts_ms=or_file_time(time_ms(record(), "$.timestamp")),
        input=guess("heard"), output=guess("chars"), is_turn_start=F.coalesce("asked", F.lit(False)), workspace=F.nullif(F.regexp_extract("path", r"projects/([^/]+)/[^/]*$", 1), F.lit("")),
    )
    return found.withColumn("dedup_key", F.concat_ws(":", "session_id", (F.row_number().over(in_file()) - 1).cast("string")))


def tiered_spans(records: DataFrame) -> DataFrame:
    """Telemetry spans and logs of one client: chat spans, inference logs, agents' turns and summaries, each (tier, trace,
    response); precedence.tiered keeps the best tier that tells of a request."""
    own = parsed(records).withColumn("attributes", F.coalesce(F.try_variant_get(record(), "$.attributes", "variant"), F.try_variant_get(record(), "$.body.attributes", "variant")))
    a = F.col("attributes")
    field = lambda k: f"$['{k}']"
    operation, event = get(a, field("gen_ai.operation.name"), "string"), F.coalesce(get(a, field("event.name"), "string"), get(record(), "$.name", "string"))
    tier = F.when(operation == "chat", "chat").when(event.rlike("inference"), "inference").when(event.rlike("agent.*turn"), "agent_turn").when(operation == "invoke_agent", "agent_summary")
    own = own.withColumn("tier", tier).withColumn("trace", get(record(), "$.traceId", "string")).withColumn("response", get(a, field("gen_ai.response.id"), "string")).where("tier is not null")
    own = precedence.tiered(own.select("path", "line", "modified", "doc", "attributes", "tier", "trace", "response"))
    n = lambda *ks: number(a, *(field(f"gen_ai.usage.{k}") for k in ks))
    read = n("cache_read.input_tokens", "cache_read_input_tokens")
    whole, thought = n("input_tokens"), n("reasoning.output_tokens", "reasoning_tokens")
    model = F.coalesce(get(a, field("gen_ai.response.model"), "string"), get(a, field("gen_ai.request.model"), "string"), F.lit("unknown"))
    return rows(
        own, "copilot", model=model, provider=provider_of(model, "github-copilot"), session_id=F.coalesce(get(a, field("gen_ai.conversation.id"), "string"), F.col("trace"), file_stem()), ts_ms=or_file_time(time_ms(record(), "$.timestamp")),
        input=whole - F.least(read, whole), output=n("output_tokens"), cache_read=read, cache_write=n("cache_creation.input_tokens", "cache_creation_input_tokens"), reasoning=thought, dedup_key=F.coalesce(F.concat(F.lit("response:"), F.col("response")), F.concat_ws(":", "trace", get(record(), "$.spanId", "string"))),
    )


# Whole documents -----------------------------------------------------------------------------------------------------


def mux(records: DataFrame) -> DataFrame:
    """A row per model of a session's totals; a model's name may begin with its provider and a colon."""
    own = entries(parsed(records), "$.byModel")
    count = lambda k: number(record(), f"$.{k}.tokens")
    cost = sum((F.coalesce(get(record(), f"$.{k}.cost_usd", "double"), F.lit(0.0)) for k in ("input", "cached", "cacheCreate", "output", "reasoning")), F.lit(0.0))
    named, prefix = F.locate(":", "name") > 0, F.substring_index("name", ":", 1)
    return rows(
        own, "mux", model=F.when(named, F.regexp_replace("name", "^[^:]*:", "")).otherwise(F.col("name")), provider=F.when(named, F.coalesce(names.provider_canonical(prefix), prefix)).otherwise(F.lit("")), session_id=segment(1),
        ts_ms=F.coalesce(get(F.col("whole"), "$.lastRequest.timestamp", "long"), F.col("modified")), input=count("input"), output=count("output"), cache_read=count("cached"), cache_write=count("cacheCreate"), reasoning=count("reasoning"),
        cost=cost, dedup_key=F.concat_ws(":", F.lit("mux"), segment(1), "name"),
    )


#: Names that the service shows and what they mean.
TRAE_MODELS = {
    "GPT-5.4": "gpt-5.4", "GPT-5.3-Codex": "gpt-5.3-codex", "GPT-5.3 Codex": "gpt-5.3-codex", "GPT-5.3": "gpt-5.3",
    "GPT-5.2-Codex": "gpt-5.2-codex", "GPT-5.2 Codex": "gpt-5.2-codex", "GPT-5.2": "gpt-5.2",
    "GPT-5.1-Codex": "gpt-5.1-codex", "GPT-5.1 Codex": "gpt-5.1-codex", "GPT-5.1": "gpt-5.1",
    "Gemini 3.1 Pro": "gemini-3.1-pro", "Gemini 3.1": "gemini-3.1", "GLM 5.1": "glm-5.1", "GLM-5.1": "glm-5.1",
    "Claude Sonnet 4.6": "claude-sonnet-4.6", "Claude-Sonnet-4.6": "claude-sonnet-4.6",
    "Claude Sonnet 4.5": "claude-sonnet-4.5", "Claude-Sonnet-4.5": "claude-sonnet-4.5",
}


def trae(records: DataFrame) -> DataFrame:
    """Exact tokens and dollars of sessions; times are seconds. A nameless model has its mode's name."""
    own = items(parsed(records), "$")
    raw, mode = F.nullif(get(record(), "$.model_name", "string"), F.lit("")), F.nullif(get(record(), "$.mode", "string"), F.lit(""))
    table = F.create_map(*(F.lit(x) for pair in TRAE_MODELS.items() for x in pair))
    model = F.coalesce(table[raw], raw, F.concat(F.lit("trae-"), F.lower(mode)), F.lit("trae-unknown"))
    session, used, u = F.nullif(get(record(), "$.session_id", "string"), F.lit("")), get(record(), "$.usage_time", "long"), "$.extra_info."
    return rows(
        own.where(session.isNotNull() & (used > 0)), "trae", model=model, provider=provider_of(model, "trae"), session_id=session, ts_ms=used * 1000, cost=F.coalesce(get(record(), "$.dollar_float", "double"), F.lit(0.0)),
        input=number(record(), u + "input_token"), output=number(record(), u + "output_token"), cache_read=number(record(), u + "cache_read_token"), cache_write=number(record(), u + "cache_write_token"),
        dedup_key=F.concat_ws(":", F.lit("trae"), session, used.cast("string")),
    )


def warp(records: DataFrame) -> DataFrame:
    """Requests and cents without tokens: a row per workspace, or the account's own where no workspace has any."""
    own = parsed(records).withColumn("said", time_ms(record(), "$.syncedAt")).where("said > 0")
    spaces = items(own, "$.workspaces")
    used = lambda doc, at: F.least(number(doc, at + "requestsUsed"), F.lit(2147483647))
    some = lambda doc, at="$.": (number(doc, at + "requestsUsed") > 0) | (number(doc, at + "spendCents") > 0)
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(get(record(), "$.id", "string"))), r"[^a-z0-9._-]", "-"), "^-+|-+$", "")
    spaces = spaces.where(some(record()))
    own = own.join(spaces.select("path", "line").distinct(), ["path", "line"], "left_anti").where(some(record(), "$.usage."))
    found = rows(
        spaces, "warp", False, model=F.lit("aggregate-requests"), provider=F.lit("warp"), session_id=F.concat(F.lit("warp-aggregate-"), F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))),
        workspace=text("$.id"), ts_ms=F.col("said"), cost=number(record(), "$.spendCents") / 100.0, message_count=used(record(), "$."),
    )
    return found.unionByName(rows(own, "warp", False, model=F.lit("aggregate-requests"), provider=F.lit("warp"), session_id=F.lit("warp-aggregate-account"), ts_ms=F.col("said"), cost=number(record(), "$.usage.spendCents") / 100.0, message_count=used(record(), "$.usage.")))


def augment(records: DataFrame) -> DataFrame:
    """A row per completed turn, from its last node with any usage."""
    own = items(parsed(records), "$.chatHistory").where(get(record(), "$.completed", "boolean"))
    u = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    nodes = F.try_variant_get(record(), "$.exchange.response_nodes", "array<variant>")
    counts = F.transform(nodes, lambda n: F.array(*(number(n, f"$.token_usage.{k}") for k in u)))
    last = F.element_at(F.filter(counts, lambda c: F.exists(c, lambda x: x > 0)), -1)
    own = own.withColumn("counts", F.when(F.size(F.filter(counts, lambda c: F.exists(c, lambda x: x > 0))) > 0, last)).where("counts is not null")
    session = F.coalesce(text("$.sessionId", F.col("whole")), file_stem())
    model = F.coalesce(text("$.exchange.model_id"), text("$.agentState.modelId", F.col("whole")), F.lit("unknown"))
    place = F.coalesce(F.concat(F.lit("req:"), text("$.exchange.request_id")), F.concat(F.lit("seq:"), F.nullif(get(record(), "$.sequenceId", "string"), F.lit(""))), F.concat(F.lit("turn:"), F.col("index").cast("string")))
    return rows(
        own, "augment", model=model, provider=provider_of(model, "augment"), session_id=session, ts_ms=or_file_time(time_ms(record(), "$.finishedAt")), is_turn_start=F.lit(True),
        input=F.col("counts")[0], output=F.col("counts")[1], cache_read=F.col("counts")[2], cache_write=F.col("counts")[3], dedup_key=F.concat_ws(":", F.lit("augment"), session, place),
    )


def gemini(records: DataFrame) -> DataFrame:
    """Messages of a session with tokens, a tool's being input. Cached tokens are taken out of the input only where the
    total shows that they are in it."""
    own = items(parsed(records), "$.messages").withColumn("t", get(record(), "$.tokens", "variant")).where("t is not null").where(get(record(), "$.model", "string").isNotNull())
    t = F.col("t")
    first = lambda *ks: F.greatest(F.coalesce(*(get(t, f"$.{k}", "long") for k in ks), F.lit(0)), F.lit(0).cast("long"))
    raw, out = first("input", "prompt", "input_tokens", "prompt_tokens", "promptTokenCount"), first("output", "candidates", "output_tokens", "completion_tokens", "candidatesTokenCount")
    cached, thought, tool = first("cached", "cached_tokens", "cachedContentTokenCount"), first("thoughts", "reasoning", "thoughts_tokens"), first("tool", "tool_tokens")
    total = F.coalesce(*(get(t, f"$.{k}", "long") for k in ("total", "totalTokenCount", "total_tokens")))
    within = (cached > 0) & (total == raw + out + thought + tool)
    session = F.coalesce(get(F.col("whole"), "$.sessionId", "string"), get(F.col("whole"), "$.session_id", "string"), file_stem())
    return rows(
        own, "gemini", False, model=get(record(), "$.model", "string"), provider=F.lit("google"), session_id=session, ts_ms=or_file_time(time_ms(record(), "$.timestamp")),
        input=F.when(F.coalesce(within, F.lit(False)), raw - F.least(cached, raw)).otherwise(raw) + tool, output=out, cache_read=cached, reasoning=thought,
    )


def task_log(records: DataFrame, client: str) -> DataFrame:
    """Requests of a task's message file; model and agent are the last named in its history file, in the same folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    history = records.where(segment(0) == "api_conversation_history.json").withColumn("folder", folder)
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)<environment_details>(.*?)</environment_details>"), F.lit(1))
    last = lambda tag: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(blocks, lambda b: F.nullif(F.trim(F.regexp_extract(b, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))), lambda x: x.isNotNull())), -1)
    history = history.select("folder", last("model").alias("said_model"), F.coalesce(last("slug"), last("name")).alias("said_agent"))
    own = items(parsed(records.where(segment(0) == "ui_messages.json")), "$").where((get(record(), "$.type", "string") == "say") & (get(record(), "$.say", "string") == "api_req_started"))
    own = own.withColumn("said", time_ms(record(), "$.ts")).where("said > 0").withColumn("doc", F.try_parse_json(get(record(), "$.text", "string"))).where("doc is not null")
    own = own.withColumn("folder", folder).join(history, "folder", "left")
    return rows(
        own, client, False, model=F.coalesce("said_model", F.lit("unknown")), provider=F.coalesce(text("$.apiProtocol"), F.lit("unknown")), session_id=segment(1), ts_ms=F.col("said"), agent=F.col("said_agent"),
        input=number(record(), "$.tokensIn"), output=number(record(), "$.tokensOut"), cache_read=number(record(), "$.cacheReads"), cache_write=number(record(), "$.cacheWrites"), cost=F.coalesce(dollars("$.cost"), F.lit(0.0)),
    )


def roocode(records: DataFrame) -> DataFrame:
    return task_log(records, "roocode")


def kilocode(records: DataFrame) -> DataFrame:
    return task_log(records, "kilocode")


def cline(records: DataFrame) -> DataFrame:
    """Task logs of the editor, and message files of the command line, whose rows follow a human prompt or not."""
    other = items(parsed(records.where(~segment(0).isin("ui_messages.json", "api_conversation_history.json"))), "$.messages")
    blocks = F.transform(F.coalesce(F.try_variant_get(record(), "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.coalesce(get(b, "$.type", "string"), F.lit("")))
    role = get(record(), "$.role", "string")
    human = (role == "user") & F.array_contains(blocks, "text") & ~F.array_contains(blocks, "tool_result")
    place = Window.partitionBy("path").orderBy("index")
    other = other.withColumn("role", role).withColumn("human", human)
    # a turn starts at the first assistant message after a human prompt
    other = other.withColumn("prompts", F.sum(F.col("human").cast("int")).over(place)).where("role = 'assistant'")
    first = F.row_number().over(Window.partitionBy("path", "prompts").orderBy("index")) == 1
    other = other.withColumn("first", first & (F.col("prompts") > 0))
    model, u = F.coalesce(text("$.modelInfo.id"), F.lit("unknown")), "$.metrics."
    session = F.coalesce(text("$.sessionId", F.col("whole")), segment(1))
    found = rows(
        other, "cline", model=model, provider=F.coalesce(text("$.modelInfo.provider"), provider_of(model, "cline")), session_id=session, ts_ms=or_file_time(time_ms(record(), "$.ts")), agent=text("$.agent", F.col("whole")),
        input=number(record(), u + "inputTokens"), output=number(record(), u + "outputTokens"), cache_read=number(record(), u + "cacheReadTokens"), cache_write=number(record(), u + "cacheWriteTokens"), cost=F.coalesce(dollars(u + "cost"), F.lit(0.0)),
        is_turn_start=F.col("first"), dedup_key=F.concat_ws(":", F.lit("cline"), session, text("$.id")),
    )
    return task_log(records, "cline").unionByName(found)


def droid(records: DataFrame) -> DataFrame:
    """Totals of a settings file; the model is named there, else in the log beside it, else it is the provider's."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.settings\.json$", ""), r"\.jsonl$", "")
    clean = lambda m: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "^custom:", ""), r"\[[^\]]*\]?", ""), "-+$", "")), r"\.", "-"), "-+", "-")
    logs = records.where(F.col("path").endswith(".jsonl")).select(stem.alias("stem"), "line", F.nullif(F.trim(F.regexp_extract("value", r'Model:([^\[\\"]*)', 1)), F.lit("")).alias("said"))
    logs = logs.where("said is not null").groupBy("stem").agg(F.min_by("said", "line").alias("said"))
    own = parsed(records.where(F.col("path").endswith(".settings.json"))).withColumn("stem", stem).join(logs, "stem", "left")
    model, u = get(record(), "$.model", "string"), "$.tokenUsage."
    provider = F.coalesce(get(record(), "$.providerLock", "string"), provider_of(F.coalesce(model, F.lit("")), "unknown"))
    family = F.create_map(*(F.lit(x) for x in ("anthropic", "claude", "openai", "gpt", "google", "gemini", "xai", "grok")))
    plain = F.coalesce(names.provider_canonical(provider), provider)
    return rows(
        own, "droid", model=F.coalesce(clean(model), clean(F.col("said")), F.concat(F.coalesce(family[plain], provider), F.lit("-unknown"))), provider=provider, session_id=F.element_at(F.split("stem", "/"), -1),
        ts_ms=or_file_time(time_ms(record(), "$.providerLockTimestamp")), input=number(record(), u + "inputTokens"), output=number(record(), u + "outputTokens"), cache_read=number(record(), u + "cacheReadTokens"), cache_write=number(record(), u + "cacheCreationTokens"), reasoning=number(record(), u + "thinkingTokens"),
    )


def codebuff(records: DataFrame, client: str = "codebuff") -> DataFrame:
    """Assistants' messages; each figure comes from the first of the places that has one above 0. Cost is credits."""
    own = items(parsed(records), "$").where(F.coalesce(get(record(), "$.variant", "string"), get(record(), "$.role", "string")).isin("ai", "agent", "assistant"))
    history = F.filter(F.coalesce(F.try_variant_get(record(), "$.metadata.runState.sessionState.mainAgentState.messageHistory", "array<variant>"), F.array().cast("array<variant>")), lambda m: get(m, "$.role", "string") == "assistant")
    own = own.withColumn("late", F.reverse(history))
    places = ["$.metadata.usage", "$.metadata.codebuff.usage"]
    behind = ["$.providerOptions.usage", "$.providerOptions.codebuff.usage"]

    def figure(*keys: str) -> Column:
        here = [F.when(number(record(), f"{p}.{k}") > 0, number(record(), f"{p}.{k}")) for p in places for k in keys]
        then = F.filter(F.flatten(F.transform("late", lambda m: F.array(*(number(m, f"{p}.{k}") for p in behind for k in keys)))), lambda x: x > 0)
        return F.coalesce(*here, F.when(F.size(then) > 0, F.element_at(then, 1)), F.lit(0).cast("long"))

    credits = [F.when(get(record(), p, "double") > 0, get(record(), p, "double")) for p in ("$.metadata.usage.credits", "$.metadata.codebuff.usage.credits")]
    more = F.filter(F.flatten(F.transform("late", lambda m: F.array(*(get(m, f"{p}.credits", "double") for p in behind)))), lambda x: x > 0)
    credit = F.coalesce(*credits, F.when(F.size(more) > 0, F.element_at(more, 1)), F.when(get(record(), "$.credits", "double") > 0, get(record(), "$.credits", "double")), F.lit(0.0))
    named = F.filter(F.flatten(F.transform("late", lambda m: F.array(get(m, "$.providerOptions.codebuff.model", "string"), *(get(m, f"{p}.model", "string") for p in behind)))), lambda x: x.isNotNull())
    model = F.coalesce(get(record(), "$.metadata.model", "string"), *(get(record(), f"{p}.model", "string") for p in places), F.when(F.size(named) > 0, F.element_at(named, 1)), F.lit(f"{client}-unknown"))
    chat = segment(1)
    from_name = F.unix_millis(F.try_to_timestamp(F.concat(F.regexp_replace(chat, r"^([^T]*T[^-]*)-([^-]*)-", "$1:$2:"), F.when(chat.rlike("Z$"), "").otherwise("Z"))))
    said = F.coalesce(*(F.nullif(time_ms(record(), p), F.lit(0).cast("long")) for p in ("$.timestamp", "$.createdAt", "$.metadata.timestamp")), from_name, F.col("modified"))
    session = F.concat_ws("/", F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-6)), F.lit("manicode")), segment(3), chat)
    found = rows(
        own, client, False, model=model, provider=provider_of(model, "unknown"), session_id=session, ts_ms=said, cost=credit,
        input=figure("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"), output=figure("outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
        cache_read=figure("cacheReadInputTokens", "cache_read_input_tokens", "cachedTokensCreated", "cached_tokens_created", "promptTokensDetails.cachedTokens", "prompt_tokens_details.cached_tokens"),
        cache_write=figure("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens"),
        dedup_key=F.coalesce(F.nullif(get(record(), "$.id", "string"), F.lit("")), F.concat_ws(":", F.lit(client), session, said.cast("string"), model, F.col("index").cast("string"))),
    )
    return found.where("input > 0 or output > 0 or cache_read > 0 or cache_write > 0 or cost > 0")


# Rows of SQLite tables, each a JSON object (see sqlite.py) ------------------------------------------------------------


def messages_table(records: DataFrame, client: str) -> DataFrame:
    """Assistants' messages with tokens, from (id, session_id, data). Times are milliseconds, or seconds where small."""
    own = parsed(records).withColumn("whole", record()).withColumn("doc", F.try_parse_json(get(record(), "$.data", "string")))
    own = own.where((get(record(), "$.role", "string") == "assistant") & get(record(), "$.tokens", "variant").isNotNull() & get(record(), "$.modelID", "string").isNotNull())
    model, stated, row = get(record(), "$.modelID", "string"), get(record(), "$.providerID", "string"), F.col("whole")
    raw = F.coalesce(stated, provider_of(model, client))
    made = get(record(), "$.time.created", "double")
    ended = get(record(), "$.time.completed", "double")
    ms = lambda x: F.when(x > 1e12, x).otherwise(x * 1000).cast("long")
    took = ms(ended) - ms(made)
    return rows(
        own, client, False, model=model, provider=F.coalesce(names.provider_canonical(raw), raw), session_id=F.coalesce(get(record(), "$.session_id", "string"), get(row, "$.session_id", "string")), ts_ms=F.coalesce(ms(made), F.col("modified")), workspace=workspace_key(get(record(), "$.path.root", "string")), duration_ms=F.when(took > 0, took),
        input=number(record(), "$.tokens.input"), output=number(record(), "$.tokens.output"), reasoning=number(record(), "$.tokens.reasoning"), cache_read=number(record(), "$.tokens.cache.read"), cache_write=number(record(), "$.tokens.cache.write"),
        cost=F.coalesce(dollars("$.cost"), F.lit(0.0)), agent=F.coalesce(get(record(), "$.agent", "string"), get(record(), "$.mode", "string")), dedup_key=F.coalesce(get(record(), "$.id", "string"), get(row, "$.id", "string")),
    )


def kilo(records: DataFrame) -> DataFrame:
    return messages_table(records, "kilo")


def opencode(records: DataFrame) -> DataFrame:
    """Rows of the database and files of single messages (the file is the message); the database's come first where both
    tell of one, see precedence.lane_order."""
    own = parsed(records)
    files = own.where(get(record(), "$.data", "string").isNull())
    wrapped = files.withColumn("value", F.to_json(F.struct(F.coalesce(get(record(), "$.id", "string"), file_stem()).alias("id"), get(record(), "$.sessionID", "string").alias("session_id"), F.col("value").alias("data"))))
    return messages_table(own.where(get(record(), "$.data", "string").isNotNull()).drop("doc").unionByName(wrapped.drop("doc")), "opencode")


def micode(records: DataFrame) -> DataFrame:
    """Message tables whose costs are the provider's own; of several rows with one fingerprint the first counts."""
    found = messages_table(records, "micode").withColumn("cost_source", F.when(F.col("cost") > 0, "reported").otherwise("unknown"))
    alike = Window.partitionBy("path", "session_id", "ts_ms", "model", "provider", *BUCKETS, "cost", "agent").orderBy("line")
    return found.withColumn("n__", F.row_number().over(alike)).where("n__ = 1").drop("n__")


def octofriend(records: DataFrame) -> DataFrame:
    """Messages with counts in columns, of a gateway's client; the client is its own whatever the model."""
    own, n = parsed(records), lambda k: number(record(), f"$.{k}")
    seconds, model = get(record(), "$.timestamp", "double"), F.coalesce(get(record(), "$.model", "string"), F.lit(""))
    return rows(
        own, "synthetic", model=model, provider=F.coalesce(text("$.provider"), F.lit("synthetic")), session_id=F.coalesce(get(record(), "$.session_id", "string"), F.lit("unknown")), ts_ms=F.when(seconds > 1e12, seconds).otherwise(seconds * 1000).cast("long"),
        input=n("input_tokens"), output=n("output_tokens"), cache_read=n("cache_read_tokens"), cache_write=n("cache_write_tokens"), reasoning=n("reasoning_tokens"), cost=F.coalesce(dollars("$.cost"), F.lit(0.0)), dedup_key=get(record(), "$.id", "string"),
    )


def crush(records: DataFrame, zone: str = "UTC") -> DataFrame:
    """A row per root session and day, its cost dealt by the days' assistant messages in the whole tree below it.

    Records are rows of both tables, told apart by a field "table". The last day takes what is left; a session with a
    cost and no such message is one row of no messages. Times of 11 digits or fewer are seconds.
    """
    own = parsed(records).withColumn("table", get(record(), "$.table", "string"))
    ms = lambda x: F.when(x >= 100_000_000_000, x).when(x > 0, x * 1000)
    when = lambda k: ms(get(record(), f"$.{k}", "long"))
    name = F.concat_ws("\0", "path", get(record(), "$.id", "string"))
    sessions = own.where("table = 'sessions'").select("path", "line", "modified", name.alias("node"), F.when(get(record(), "$.parent_session_id", "string").isNotNull(), F.concat_ws("\0", "path", get(record(), "$.parent_session_id", "string"))).alias("parent"), F.coalesce(get(record(), "$.cost", "double"), F.lit(0.0)).alias("cost"), F.coalesce(get(record(), "$.message_count", "long"), F.lit(0)).alias("n"), F.coalesce(when("updated_at"), when("created_at")).alias("last"), get(record(), "$.id", "string").alias("id"))
    roots = sessions.where("parent is null and (n > 0 or cost > 0)")
    tree = hierarchy.descendants(records.sparkSession, sessions.select("node", "parent"))
    said = own.where((F.col("table") == "messages") & (get(record(), "$.role", "string") == "assistant")).select(F.concat_ws("\0", "path", get(record(), "$.session_id", "string")).alias("node"), when("created_at").alias("at")).where("at is not null")
    days = said.join(tree, "node").groupBy("root", F.to_date(F.from_utc_timestamp(F.timestamp_millis("at"), zone)).alias("day")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("messages"))
    both = roots.join(days.withColumnRenamed("root", "node"), "node", "left")
    order, whole = Window.partitionBy("node").orderBy("day"), Window.partitionBy("node")
    spent = F.greatest("cost", F.lit(0.0))
    share = spent * F.col("messages") / F.sum("messages").over(whole)
    before = F.coalesce(F.sum(spent * F.col("messages")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("messages").over(whole)
    last = F.row_number().over(order) == F.count(F.lit(1)).over(whole)
    both = both.withColumn("own", F.when(F.col("day").isNull(), spent).when(last, F.greatest(spent - before, F.lit(0.0))).otherwise(share)).where("day is not null or (cost > 0 and last is not null)")
    return rows(both, "crush", False, model=F.lit("session-total"), provider=F.lit("crush"), session_id=F.concat_ws(":", "path", "id"), ts_ms=F.coalesce("at", "last"), cost=F.col("own"), message_count=F.coalesce("messages", F.lit(0)))


def goose(records: DataFrame) -> DataFrame:
    """A row per session, accumulated counts first; what the total has beyond input and output is reasoning."""
    own = parsed(records).withColumn("model", text("$.model_name", F.try_parse_json(get(record(), "$.model_config_json", "string")))).where("model is not null")
    first = lambda k: F.greatest(F.coalesce(get(record(), f"$.accumulated_{k}", "long"), get(record(), f"$.{k}", "long"), F.lit(0)), F.lit(0).cast("long"))
    read, wrote, total = first("input_tokens"), first("output_tokens"), first("total_tokens")
    said = get(record(), "$.created_at", "string")
    when = F.coalesce(F.unix_millis(F.try_to_timestamp(F.when(said.rlike("Z|[+-][0-9]{2}:?[0-9]{2}$"), said).otherwise(F.concat(said, F.lit("Z"))))), F.unix_millis(F.try_to_timestamp(said, F.lit("yyyy-MM-dd"))), F.lit(0).cast("long"))
    found = rows(
        own, "goose", False, model=F.col("model"), provider=provider_of(F.col("model"), "goose", text("$.provider_name")), session_id=get(record(), "$.id", "string"), ts_ms=when,
        input=read, output=wrote, reasoning=F.greatest(total - read - wrote, F.lit(0)), dedup_key=get(record(), "$.id", "string"),
    )
    return found.where("input > 0 or output > 0 or reasoning > 0")


def hermes(records: DataFrame) -> DataFrame:
    """Usage per session, model and provider; sessions without rows there count by their own totals.

    Records are rows of both tables, told apart by a field "table". A session's messages go to its first row: that of the
    session's own model if there is one, then by model and provider. Costs are per row the actual one unless it is 0.
    """
    own = parsed(records).withColumn("table", get(record(), "$.table", "string"))
    n = lambda k: F.coalesce(get(record(), f"$.{k}", "long"), F.lit(0))
    seconds = get(record(), "$.started_at", "double")
    when = F.when(seconds > 1e12, seconds).otherwise(seconds * 1000).cast("long")
    counts = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_write_tokens", "reasoning": "reasoning_tokens"}
    actual, guess = get(record(), "$.actual_cost_usd", "double"), get(record(), "$.estimated_cost_usd", "double")
    sessions = own.where("table = 'sessions'").select(
        "path", "line", "modified", get(record(), "$.id", "string").alias("session"), text("$.model").alias("own_model"), get(record(), "$.billing_provider", "string").alias("own_billed"), when.alias("ts_ms"), n("message_count").alias("messages"),
        *(n(v).alias(f"own_{k}") for k, v in counts.items()), F.coalesce(actual, guess, F.lit(0.0)).alias("own_cost"),
    )
    usage = own.where("table = 'session_model_usage'").select("path", get(record(), "$.session_id", "string").alias("session"), text("$.model").alias("model"), get(record(), "$.billing_provider", "string").alias("billed"), *(n(v).alias(k) for k, v in counts.items()), F.coalesce(F.nullif(actual, F.lit(0.0)), guess, F.lit(0.0)).alias("cost"))
    sums = usage.where("model is not null").groupBy("path", "session", "model", "billed").agg(*(F.sum(k).alias(k) for k in counts), F.sum("cost").alias("cost"))
    some = " or ".join(f"{k} > 0" for k in (*counts, "cost"))
    per_model = sums.where(some).join(sessions, ["path", "session"])
    first = Window.partitionBy("path", "session").orderBy((F.col("model") != F.coalesce("own_model", F.lit(""))).cast("int"), "model", F.col("billed").asc_nulls_first())
    per_model = per_model.withColumn("messages", F.when(F.row_number().over(first) == 1, F.col("messages")).otherwise(0))
    rest = sessions.join(per_model.select("path", "session").distinct(), ["path", "session"], "left_anti").where("own_model is not null")
    rest = rest.select("path", "line", "modified", "session", "ts_ms", "messages", F.col("own_model").alias("model"), F.col("own_billed").alias("billed"), *(F.col(f"own_{k}").alias(k) for k in (*counts, "cost"))).where(some)
    both = per_model.select(*rest.columns).unionByName(rest)
    return rows(
        both, "hermes", False, model=F.col("model"), provider=provider_of(F.col("model"), "hermes", F.col("billed")), session_id=F.col("session"), ts_ms=F.col("ts_ms"), cost=F.col("cost"), message_count=F.col("messages"),
        dedup_key=F.concat_ws(":", F.lit("hermes"), "session", "model", F.coalesce("billed", F.lit(""))), **{k: F.greatest(F.col(k), F.lit(0).cast("long")) for k in counts},
    )


#: How each client's logs are found: the reader of its files, a glob, and the dialect.
LINES = {"qwen": ("*.jsonl", qwen), "reasonix": ("*.jsonl", reasonix), "junie": ("events.jsonl", junie), "gjc": ("*.jsonl", gjc), "opencodereview": ("*.jsonl", opencodereview), "antigravity": ("*.jsonl", antigravity), "senpi": ("*.jsonl", senpi), "kimchi": ("*.jsonl", kimchi), "openclaw": ("*.jsonl*", openclaw), "copilot": ("*.jsonl", tiered_spans)}
DOCUMENTS = {"gemini": ("*.json", gemini), "mux": ("session-usage.json", mux), "trae": ("*.json", trae), "warp": ("usage*.json", warp), "augment": ("*.json", augment), "roocode": ("*.json", roocode), "kilocode": ("*.json", kilocode), "cline": ("*.json", cline), "codebuff": ("chat-messages.json", codebuff)}
