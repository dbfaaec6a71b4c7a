"""Usage logs of assistants: JSON lines, JSON documents and CSV exports as rows of usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "client string, provider string, model string, session_id string, workspace string, ts_ms long, input long, output long, cache_read long, cache_write long, reasoning long, cost double, dedup_key string, path string, line long, message_count int, duration_ms long, agent string, cost_source string, is_turn_start boolean"


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(value), r"^\uFEFF", ""), "\r$", "")


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line, modified, value) of text files below a folder: bad bytes stay within their line, marks and returns go."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    # the number only orders lines of one file: rows of a file are read in order within a split, splits by their offset
    return raw.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("line"), F.unix_millis("_metadata.file_modification_time").alias("modified"), _clean(F.col("value")).alias("value"))


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, line, modified, value) of whole text files, a row each."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("line"), F.unix_millis("_metadata.file_modification_time").alias("modified"), _clean(F.col("value")).alias("value"))


def get(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def number(doc: Column, *paths: str) -> Column:
    """A count at the first path that has one, as number or text; never below 0."""
    found = [F.coalesce(get(doc, p, "long"), get(doc, p, "double").cast("long"), F.try_to_number(get(doc, p, "string"), F.lit("999999999999999999")).cast("long")) for p in paths]
    return F.greatest(F.coalesce(*found, F.lit(0).cast("long")), F.lit(0).cast("long"))


def time_ms(doc: Column, path: str) -> Column:
    """Milliseconds of a time as text (without zone: UTC), or as number of seconds or milliseconds."""
    n = get(doc, path, "double")
    parsed = F.unix_millis(F.try_to_timestamp(F.when(get(doc, path, "string").rlike("Z|[+-][0-9]{2}:?[0-9]{2}$"), get(doc, path, "string")).otherwise(F.concat(get(doc, path, "string"), F.lit("Z")))))
    return F.coalesce(F.when(n.isNotNull(), F.when(n < 1e12, n * 1000).otherwise(n).cast("long")), parsed, F.lit(0).cast("long"))


def _rows(docs: DataFrame, **columns: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    all_ = {"client": None, "provider": None, "model": None, "session_id": None, "workspace": None, "ts_ms": zero, "input": zero, "output": zero, "cache_read": zero, "cache_write": zero, "reasoning": zero, "cost": None, "dedup_key": None, "message_count": F.lit(1), "duration_ms": None, "agent": None, "cost_source": F.lit("unknown"), "is_turn_start": F.lit(False)} | columns
    own = docs.select(*(F.lit(None).alias(k) if v is None else v.alias(k) for k, v in all_.items()), "path", "line")
    return own.select(*(F.col(n).cast(t) for n, t in (x.strip().split(" ") for x in USAGE.split(","))))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds doc, a variant; lines that aren't JSON go."""
    return rows.withColumn("doc", F.try_parse_json("value")).where("doc is not null")


def claude(spark: SparkSession, path: str) -> DataFrame:
    return claude_rows(lines(spark, path))


def claude_rows(records: DataFrame) -> DataFrame:
    """Lines of assistant messages; streamed repeats of one message keep each count's maximum in dedup.max_merge.

    Results of tools that report usage of their own are rows too. The first assistant's line after a human's starts a
    turn; lines of a side chain have their agent's name.
    """
    d = F.col("doc")
    own = parsed(records)
    in_file = Window.partitionBy("path").orderBy("line")
    kinds = F.transform(F.coalesce(F.try_variant_get(d, "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.coalesce(get(b, "$.type", "string"), F.lit("")))
    role = get(d, "$.type", "string")
    human = (role == "user") & ~F.coalesce(get(d, "$.isMeta", "boolean"), F.lit(False)) & ~F.coalesce(get(d, "$.isSidechain", "boolean"), F.lit(False)) & ~F.array_contains(kinds, "tool_result")
    own = own.withColumn("human", F.coalesce(human, F.lit(False))).withColumn("prompts", F.sum(F.col("human").cast("int")).over(in_file))
    answer = role == "assistant"
    own = own.withColumn("first", answer & (F.col("prompts") > 0) & (F.row_number().over(Window.partitionBy("path", "prompts", answer).orderBy("line")) == 1))
    tools = own.where(role == "user").withColumn("usage", F.try_variant_get(d, "$.toolUseResult.usage", "variant")).where("usage is not null")
    own = own.where(get(d, "$.type", "string") == "assistant").where(get(d, "$.message.usage", "variant").isNotNull())
    message, request = get(d, "$.message.id", "string"), get(d, "$.requestId", "string")
    key = F.when(message.isNotNull() & request.isNotNull(), F.concat_ws(":", message, request)).when(message.isNotNull(), F.concat(F.lit("message:"), message))
    u = "$.message.usage."
    found = _rows(own, client=F.lit("claude"), provider=F.coalesce(get(d, "$.providerId", "string"), F.lit("anthropic")), model=get(d, "$.message.model", "string"), session_id=get(d, "$.sessionId", "string"), workspace=get(d, "$.cwd", "string"), ts_ms=time_ms(d, "$.timestamp"), input=number(d, u + "input_tokens"), output=number(d, u + "output_tokens"), cache_read=number(d, u + "cache_read_input_tokens"), cache_write=number(d, u + "cache_creation_input_tokens"), dedup_key=key, is_turn_start=F.col("first"), agent=F.when(F.coalesce(get(d, "$.isSidechain", "boolean"), F.lit(False)), get(d, "$.agentId", "string")))
    w, session = F.col("usage"), get(d, "$.sessionId", "string")
    asked = F.element_at(F.concat(F.transform(F.coalesce(F.try_variant_get(d, "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: get(b, "$.tool_use_id", "string")), F.array(F.lit(None).cast("string"))), 1)
    told = _rows(tools, client=F.lit("claude"), provider=F.lit("anthropic"), model=F.coalesce(get(d, "$.toolUseResult.model", "string"), F.lit("unknown")), session_id=session, workspace=get(d, "$.cwd", "string"), ts_ms=time_ms(d, "$.timestamp"), input=number(w, "$.input_tokens"), output=number(w, "$.output_tokens"), cache_read=number(w, "$.cache_read_input_tokens"), cache_write=number(w, "$.cache_creation_input_tokens"), dedup_key=F.concat_ws(":", F.lit("claude:tool_result"), session, asked), agent=get(d, "$.toolUseResult.agentId", "string"))
    return found.unionByName(told)


def codex(spark: SparkSession, path: str) -> DataFrame:
    from . import codex as machine

    return machine.codex_rows(lines(spark, path))


def pi(spark: SparkSession, path: str, client: str = "pi") -> DataFrame:
    d, u = F.col("doc"), "$.message.usage."
    own = parsed(lines(spark, path)).where((get(d, "$.type", "string") == "message") & (get(d, "$.message.role", "string") == "assistant"))
    session = F.regexp_extract("path", r"([^/]*?)\.jsonl$", 1)
    return _rows(own, client=F.lit(client), provider=get(d, "$.message.provider", "string"), model=get(d, "$.message.model", "string"), session_id=session, ts_ms=time_ms(d, "$.timestamp"), input=number(d, u + "input"), output=number(d, u + "output"), cache_read=number(d, u + "cacheRead"), cache_write=number(d, u + "cacheWrite"), reasoning=number(d, u + "reasoning"), dedup_key=get(d, "$.id", "string"))


def money(text: Column) -> Column:
    """Dollars of a text such as $1,234.56; 0 for words, dashes and what isn't a number."""
    return F.coalesce(F.nanvl(F.regexp_replace(text, r"[$,\s]", "").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def cursor(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports of any generation, also mixed in one folder: each file's columns go by the names in its own header."""
    rows = lines(spark, path, "usage*.csv").where(F.trim("value") != "")
    return cursor_rows(rows)


def cursor_rows(records: DataFrame) -> DataFrame:
    """The same from (path, line, modified, value): the first line of a file names its columns."""
    fields = lambda c: F.transform(F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(r',(?:"((?:[^"]|"")*)"|([^,]*))'), F.lit(0)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, '^,"?|"$', ""), '""', '"')))
    first = records.groupBy("path").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("header")).withColumn("header", fields(F.col("header")))
    own = records.join(first, "path").where("line > first").withColumn("cells", fields(F.col("value")))
    own = own.withColumn("row", F.map_from_arrays("header", F.transform("header", lambda _, i: F.get("cells", i))))
    cell = lambda *ns: F.coalesce(*(F.nullif(F.try_element_at("row", F.lit(n)), F.lit("")) for n in ns))
    count = lambda c: F.greatest(F.coalesce(F.regexp_replace(cell(c), ",", "").try_cast("long"), F.lit(0)), F.lit(0))
    date = cell("Date")
    zoned = F.when(date.rlike("Z|[0-9][+-][0-9]{2}:?[0-9]{2}$"), date).otherwise(F.concat(date, F.lit("Z")))
    ts = F.coalesce(F.unix_millis(F.try_to_timestamp(zoned)), F.unix_millis(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))), F.lit(0).cast("long"))
    own = own.where(cell("Model").isNotNull())
    return _rows(own, client=F.lit("cursor"), provider=F.lit("cursor"), model=cell("Model"), session_id=F.concat(F.lit("cursor-"), F.substring(date, 1, 10)), ts_ms=ts, input=count("Input (w/o Cache Write)"), output=count("Output Tokens"), cache_read=count("Cache Read"), cache_write=count("Input (w/ Cache Write)"), cost=money(F.coalesce(cell("Cost to you", "Cost"), F.lit(""))))


READERS = {"claude": claude, "codex": codex, "pi": pi, "cursor": cursor}


def read(spark: SparkSession, client: str, path: str) -> DataFrame:
    """Rows of usage of all of a client's logs below a folder; bad files and lines are left out."""
    from . import dialects, sqlite

    if client in READERS:
        return READERS[client](spark, path)
    if client in dialects.LINES:
        glob, dialect = dialects.LINES[client]
        return dialect(lines(spark, path, glob))
    if client in dialects.DOCUMENTS:
        glob, dialect = dialects.DOCUMENTS[client]
        return dialect(documents(spark, path, glob))
    if client == "droid":  # a document of settings, and the lines of the log beside it
        return dialects.droid(documents(spark, path, "*.settings.json").unionByName(lines(spark, path)))
    if client == "commandcode":  # lines, and the settings two folders above
        return dialects.commandcode(lines(spark, path).unionByName(documents(spark, path, "config.json")))
    if client in sqlite.TABLES:
        glob, queries, dialect = sqlite.TABLES[client]
        return dialect(sqlite.records(spark, path, glob, queries))
    raise ValueError(f"no reader for {client}")
