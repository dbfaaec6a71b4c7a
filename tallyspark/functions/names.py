"""Names of models, providers, workspaces and agents in one spelling, and numbers for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of providers that mean the same.
PROVIDER_FOLDS = {
    "x_ai": "xai", "z_ai": "zai", "moonshot": "moonshotai", "meta": "meta_llama", "azure": "azure_ai", "vertex": "anthropic",
    "vertex_ai": "anthropic", "together": "together_ai", "fireworks": "fireworks_ai", "gemini": "google",
    "openai_codex": "openai", "minimaxai": "minimax", "minimax_ai": "minimax", "mistral": "mistralai",
    "deepseek_ai": "deepseek", "novita_ai": "novita", "stepfun_ai": "stepfun",
}


def model_normalize(name: Column) -> Column:
    """Lower case, no effort suffix in brackets, no date suffix, dashes in versions of one family."""
    x = F.lower(name)
    x = F.regexp_replace(x, r"^(\S(?:.*\S)?)\((?:minimal|low|medium|high|xhigh|auto|none)\)$", "$1")
    x = F.when(F.length(x) > 9, F.regexp_replace(x, r"-[0-9]{8}$", "")).otherwise(x)
    x = F.when(x.contains("claude"), F.regexp_replace(x, r"(?<=[0-9])\.(?=[0-9])", "-")).otherwise(x)
    return F.regexp_replace(x, r"^anthropic/claude-([0-9]+)-([0-9]+)-(opus|sonnet|haiku)$", "claude-$3-$1-$2")


def provider_canonical(name: Column) -> Column:
    """One spelling of a provider; null for none, placeholders and other names with digits."""
    x = F.regexp_replace(F.lower(F.regexp_replace(F.trim(name), r"^/+|/+$", "")), "-", "_")
    folded = F.lit(None).cast("string")
    for k, v in PROVIDER_FOLDS.items():
        folded = F.when(x == k, v).otherwise(folded)
    return F.when(x.rlike("^<.*>$") | (x == "") | (x == "unknown"), F.lit(None)).when(folded.isNotNull(), folded).when((x != "ai21") & x.rlike("[0-9]"), F.lit(None)).otherwise(x)


def delimited(x: Column, *words: str) -> Column:
    return x.rlike(rf"(^|[^a-z0-9])({'|'.join(words)})($|[^a-z0-9])")


def provider_infer(model: Column) -> Column:
    """The provider that a model's name shows; the first rule that holds counts."""
    m = F.regexp_replace(F.lower(model), "^ollama/", "")
    rules = [
        (m.rlike("claude|anthropic") | delimited(m, "opus", "sonnet", "haiku", "fable"), "anthropic"),
        (m.rlike("gpt|openai") | delimited(m, "o1", "o3", "o4"), "openai"),
        (m.rlike("gemini|google"), "google"),
        (m.contains("grok"), "xai"),
        (m.contains("deepseek"), "deepseek"),
        (m.contains("minimax"), "minimax"),
        (m.rlike("mistral|mixtral"), "mistral"),
        (m.contains("llama") | delimited(m, "meta"), "meta"),
        (m.contains("qwen"), "qwen"),
        (m.contains("fugu"), "sakana"),
        (delimited(m, "kimi", "k2", "k3"), "moonshotai"),
        (delimited(m, "mimo"), "xiaomi"),
        (delimited(m, "glm"), "zai"),
    ]
    found = F.lit(None).cast("string")
    for holds, provider in reversed(rules):
        found = F.when(holds, provider).otherwise(found)
    return found


def workspace_label(path: Column) -> Column:
    """The last segment of a workspace path; null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1), F.lit(""))


def client_surface(client: Column) -> Column:
    return F.when(client.startswith("cc-mirror/"), "claude").when(client == "9router", "gjc").otherwise(client)


def agent_name(name: Column) -> Column:
    """No zero-width characters, single blanks, words in title case; null if nothing is left."""
    x = F.trim(F.regexp_replace(F.regexp_replace(name, r"[\u200B-\u200D\uFEFF]", ""), r"[\s_-]+", " "))
    return F.nullif(F.initcap(x), F.lit(""))


def fmt_tokens(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000_000, F.concat(F.format_string("%.2f", n / 1e9), F.lit("B")))
        .when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def fmt_cost(dollars: Column) -> Column:
    return F.concat(F.when(dollars < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(dollars), 2))


def cost_per_million(cost: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, cost * 1e6 / tokens)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def shortened(text: Column, most: int = 1000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
