"""Which row of the price catalogues a model's name means: stages from exact keys to contained names.

Names are few beside the rows that use them, so each distinct (model, provider) pair is resolved once, in the tasks that
hold the pairs, and the answer is joined to the rows by equality. Catalogues are files of prices; their size doesn't
depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that route to other models and have no price of their own.
ROUTING = ("auto", "agent_review")
#: Names under which models are sold by others.
RESELLERS = ("azure", "azure_ai", "bedrock", "vertex_ai", "together", "together_ai", "fireworks_ai", "groq", "openrouter", "orcarouter")
#: Names of those who make the models.
VENDORS = ("x-ai", "xai", "anthropic", "openai", "google", "meta-llama", "mistralai", "minimax", "deepseek", "z-ai", "qwen", "cohere", "perplexity", "moonshotai")
#: Vendors tried in front of a bare name.
PREFIXES = ("openai", "anthropic", "google", "meta-llama", "mistralai", "minimax", "deepseek", "qwen", "cohere", "perplexity", "x-ai")
#: Words that are part of many names and tell nothing; shorter names than the least length don't either.
VAGUE, LEAST = ("auto", "mini", "chat", "base", "claude", "anthropic", "gemini", "model", "router", "default"), 5
#: Other names of models.
ALIASES = {
    "big-pickle": "glm-4.7", "big pickle": "glm-4.7", "bigpickle": "glm-4.7",
    "k2p5": "kimi-k2-thinking", "k2-p5": "kimi-k2-thinking", "k2p6": "kimi-k2.6", "k2-p6": "kimi-k2.6", "kimi-k2p6": "kimi-k2.6",
    "kimi-k2.5-thinking": "kimi-k2-thinking", "kimi-for-coding": "kimi-k2.5", "kimi-for-coding-highspeed": "kimi-k2.7-code-highspeed", "k3": "kimi-k3",
    "minimax-m3": "minimax/MiniMax-M3",
    "model_placeholder_m26": "claude-opus-4-6", "model_placeholder_m35": "claude-sonnet-4-6", "model_placeholder_m36": "gemini-3.1-pro",
    "model_placeholder_m37": "gemini-3.1-pro", "model_placeholder_m16": "gemini-3.1-pro", "model_placeholder_m18": "gemini-3-flash-preview",
    "model_placeholder_m84": "gemini-3-flash-preview", "model_placeholder_m132": "gemini-3.5-flash-high", "model_placeholder_m133": "gemini-3.5-flash-high",
    "model_placeholder_m187": "gemini-3.5-flash-extra-low", "model_placeholder_m20": "gemini-3.5-flash-medium",
    "gemini-pro-default": "gemini-3.1-pro", "gemini-pro-agent": "gemini-3.1-pro", "gemini-3-flash-agent": "gemini-3.5-flash-high",
    "gemini-3-flash-b": "gemini-3.5-flash-high", "gemini-3.5-flash-low": "gemini-3.5-flash-medium", "model_placeholder_m47": "gemini-3-flash-preview",
    "model_openai_gpt_oss_120b_medium": "gpt-oss-120b-medium",
    "claude-opus-4-6-thinking": "claude-opus-4-6", "claude-sonnet-4-6-thinking": "claude-sonnet-4-6",
    "claude-opus-4.6-thinking": "claude-opus-4-6", "claude-sonnet-4.6-thinking": "claude-sonnet-4-6",
    "claude-opus-4-6": "claude-opus-4-6", "claude-sonnet-4-6": "claude-sonnet-4-6", "claude-haiku-4-6": "claude-haiku-4-6",
    "claude-opus-4.6": "claude-opus-4-6", "claude-sonnet-4.6": "claude-sonnet-4-6", "claude-haiku-4.6": "claude-haiku-4-6",
    "claude-opus-4-0": "claude-opus-4", "claude-sonnet-4-0": "claude-sonnet-4", "claude-opus-41": "claude-opus-4-1",
    "anthropic/claude-4-5-opus": "claude-opus-4-5", "anthropic/claude-4-5-sonnet": "claude-sonnet-4-5", "anthropic/claude-4-5-haiku": "claude-haiku-4-5",
    "anthropic/claude-4-6-opus": "claude-opus-4-6", "anthropic/claude-4-6-sonnet": "claude-sonnet-4-6", "anthropic/claude-4-6-haiku": "claude-haiku-4-6",
    "gemini-3.1-pro-high": "gemini-3.1-pro", "gemini-3.1-pro-low": "gemini-3.1-pro", "gemini-3-pro-high": "gemini-3-pro", "gemini-3-pro-low": "gemini-3-pro",
    "gemini-3-flash": "gemini-3-flash-preview", "gemini-3-flash-c": "gemini-3-flash-preview", "gemini-3-flash-a": "gemini-3.5-flash-high",
    "grok-composer-2.5": "composer-2.5", "grok-composer-2.5-fast": "composer-2.5-fast",
    "kimi-k2.5-nvfp4": "kimi-k2.5", "kimi-k2-instruct-0905": "kimi-k2.5",
}

_DATE = re.compile(r"-[0-9]{8}$")
_MINOR = re.compile(r"(?<![0-9])([0-9])-(?=[0-9](?![0-9]))")


def usable(rows: Iterable[tuple[str, str, float | None]]) -> list[tuple[str, str]]:
    """(source, key) of catalogue rows (source, key, input rate) that may be used: those of one reseller's seats, and those
    without a base rate, are left out."""
    return [(s, k) for s, k, rate in rows if not k.startswith("github_copilot/") and rate is not None and rate >= 0]


@dataclass(frozen=True)
class Catalogue:
    """Keys of all sources, in the sources' order."""

    keys: tuple[tuple[str, str], ...]

    def _ranked(self, found: list[tuple[str, str]], provider: str | None, spelled: str) -> tuple[str, str] | None:
        """The best of several rows: the provider's own, a maker's, the name as it is spelled, none of a reseller's, the
        longest; then the sources' order and the key."""
        order = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in self.keys))}

        def rank(row: tuple[str, str]):
            source, key = row
            root = key.partition("/")[0].lower() if "/" in key else ""
            own = provider is not None and root.replace("-", "_") == provider.replace("-", "_")
            return not own, root not in VENDORS, key.lower() != spelled and key.lower().rpartition("/")[2] != spelled, root in RESELLERS, -len(key), order[source], key

        return min(found, key=rank, default=None)

    def _exact(self, name: str, provider: str | None):
        return self._ranked([(s, k) for s, k in self.keys if k.lower() == name], provider, name)

    def _under(self, name: str, provider: str | None):
        """Keys whose last part is the name."""
        return self._ranked([(s, k) for s, k in self.keys if "/" in k and k.lower().rpartition("/")[2] == name], provider, name)

    def _contained(self, name: str, provider: str | None):
        if len(name) < LEAST or name in VAGUE:
            return None
        inside = re.compile(rf"(^|[^a-z0-9]){re.escape(name)}($|[^a-z0-9])")
        within = [(s, k) for s, k in self.keys if inside.search(k.lower())]
        if within:
            return self._ranked(within, provider, name)
        parts = [(s, k) for s, k in self.keys if len(p := k.lower().rpartition("/")[2]) >= LEAST and p not in VAGUE and re.search(rf"(^|[^a-z0-9]){re.escape(p)}($|[^a-z0-9])", name)]
        return self._ranked(parts, provider, name)

    def _spellings(self, name: str) -> list[str]:
        """The name, its alias, and either with dots in its version or without its date."""
        out = [name]
        for x in (ALIASES.get(name), _DATE.sub("", name), _MINOR.sub(r"\1.", name), re.sub(r"(?<=[0-9])\.(?=[0-9])", "-", name)):
            if x and x.lower() not in out:
                out.append(x.lower())
        return out

    def _find(self, name: str, provider: str | None, loose: bool):
        for spelled in self._spellings(name):
            if "/" in spelled and (hit := self._exact(spelled, provider)):
                return "path", hit
        for stage, look in (("exact", self._exact), ("prefix", lambda n, p: next((h for v in PREFIXES if (h := self._exact(f"{v}/{n}", p))), None)), ("under", self._under)):
            for spelled in self._spellings(name):
                if hit := look(spelled, provider):
                    return stage, hit
        return ("fuzzy", hit) if loose and (hit := self._contained(name, provider)) else None

    def resolve(self, model: str | None, provider: str | None = None) -> tuple[str, str, str] | None:
        """(stage, source, key) of the row that a model's name means, or None.

        Found as it is; else without a provider's prefix; else less up to four parts at its end; else less up to two at
        its start. Parts are taken off only down to names that tell something, and a shorter name must be found exactly.
        """
        name = (model or "").strip().lower()
        if not name or name in ROUTING or name.rpartition("/")[2] in ROUTING:
            return None
        hint = provider.strip().lower() if provider else None
        if hit := self._find(name, hint, True):
            return hit[0], *hit[1]
        bare = name.rpartition("/")[2]
        if bare != name and (hit := self._find(bare, hint, True)):
            return "bare", *hit[1]
        pieces = bare.split("-")
        for stage, cuts in (("suffix", [pieces[:-n] for n in range(1, 5)]), ("start", [pieces[n:] for n in range(1, 3)])):
            for left in cuts:
                short = "-".join(left)
                if len(short) >= LEAST and short not in VAGUE and (hit := self._find(short, hint, False)):
                    return stage, *hit[1]
        return None


def resolve_pairs(usage: DataFrame, catalogue: Iterable[tuple[str, str]]) -> DataFrame:
    """(model, provider, stage, source, key) of each distinct pair of usage; nulls where no row is meant."""
    told = usage.sparkSession.sparkContext.broadcast(Catalogue(tuple(catalogue)))

    def run(batches):
        for batch in batches:
            pairs = list(zip(batch.column("model").to_pylist(), batch.column("provider").to_pylist(), strict=True))
            found = [told.value.resolve(m, p) or (None, None, None) for m, p in pairs]
            columns = [batch.column("model"), batch.column("provider"), *(pa.array([x[i] for x in found], pa.string()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["model", "provider", "stage", "source", "key"])

    pairs = usage.select(F.col("model").cast("string"), F.col("provider").cast("string")).distinct()
    return pairs.mapInArrow(run, "model string, provider string, stage string, source string, key string")


def with_key(usage: DataFrame, catalogue: Iterable[tuple[str, str]]) -> DataFrame:
    """usage with the catalogue key that each row's model means (price_key)."""
    found = resolve_pairs(usage, catalogue).select(F.col("model").alias("m__"), F.col("provider").alias("p__"), F.col("key").alias("price_key"))
    return usage.join(found, F.col("model").eqNullSafe(F.col("m__")) & F.col("provider").eqNullSafe(F.col("p__")), "left").drop("m__", "p__")
