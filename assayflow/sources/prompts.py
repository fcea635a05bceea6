"""Prompts and chat messages: assembled from columns, in the shapes that providers take, and sent.

The wording is this package's own; a prompt file may replace each template.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD_DDL, blank
from .answers import prompt

TEMPLATES = {
    "table": "Read this table into records.\nCaption: {caption}\nFootnote: {footnote}\nTable:\n{table}\nText around it:\n{context}",
    "aggregate": "Several models read one paper. Settle on one list of records.\nPaper:\n{text}\n\nWhat they found:\n{candidates}",
    "validate": "Check each value of this record against the text. Answer MATCH, MISMATCH or UNCERTAIN for each.\nRecord: {record}\nText:\n{context}",
    "review": "Review these records of one paper.\nDOI: {doi}\nRecords:\n{records}\nChecks:\n{checks}\nText:\n{text}",
    "conditions": "List the optimal pH and temperature of each enzyme and variant.\nText:\n{text}",
    "substrate": "Which of these substances are mycotoxins? Answer with a list of names.\n{names}",
}
KEY_FIELDS = ("enzyme_name", "substrate", "organism", "mutations", "Km_value", "Km_unit", "kcat_value", "kcat_unit")


def prompt_files(spark: SparkSession, path: str) -> DataFrame:
    """name, template of the text files of a folder (O-S8)."""
    files = spark.read.format("text").option("wholetext", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", "")
    return files.select(name.alias("name"), F.col("value").alias("template"))


def assembled(kind: str, templates: dict[str, str] | None = None, **columns: Column) -> Column:
    """A prompt of one of the six kinds (O-P7)."""
    return prompt({**TEMPLATES, **(templates or {})}[kind], **columns)


def brief(fields: tuple[str, ...] = KEY_FIELDS) -> Column:
    """The filled key fields of a record as JSON."""
    return F.to_json(F.struct(*[F.when(~blank(F.col(c), RECORD_DDL[c]), F.col(c)).alias(c) for c in fields]))


def numbered(rows: DataFrame, line: Column, keys: tuple[str, ...], order: tuple[str, ...], most: int = 200) -> DataFrame:
    """keys, lines: a numbered list of each key's first `most` lines, in order; what is left out is said."""
    item = F.struct(*order, line.alias("__l"))
    each = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("x"), F.count("*").alias("n"))
    first = F.transform(F.slice("x", 1, most), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["__l"]))
    text = F.array_join(first, "\n")
    more = F.concat(text, F.lit("\n... and "), (F.col("n") - most).cast("string"), F.lit(" more"))
    return each.select(*keys, F.when(F.col("n") > most, more).otherwise(text).alias("lines"))


def candidates_by_model(records: DataFrame, most: int = 200) -> DataFrame:
    """paper_name, candidates: what each model found, for the aggregating prompt."""
    each = numbered(records.withColumn("__b", brief()), F.col("__b"), ("paper_name", "model"), ("rec_idx",), most)
    block = F.struct("model", F.concat(F.lit("## "), "model", F.lit("\n"), "lines").alias("t"))
    return each.groupBy("paper_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"]), "\n\n").alias("candidates"))


# ---------------------------------------------------------------- providers


@dataclass(frozen=True)
class Provider:
    """Where a provider's chat lives, and which shape its messages have: openai, anthropic, gemini or ollama."""

    url: str
    shape: str = "openai"
    key: str = ""
    temperature: float = 0.0
    max_tokens: int = 8192
    timeout: float = 120.0


def payload(provider: Provider, model: str, system: str, user: str, images: list[tuple[str, str]] = ()) -> dict:
    """The body of a request in the provider's shape (O-P9). images: (mime, base64)."""
    if provider.shape == "anthropic":
        parts: list[dict] = [{"type": "image", "source": {"type": "base64", "media_type": m, "data": d}} for m, d in images]
        parts.append({"type": "text", "text": user})
        body = {"model": model, "max_tokens": provider.max_tokens, "temperature": provider.temperature, "messages": [{"role": "user", "content": parts}]}
        return body | ({"system": system} if system else {})
    if provider.shape == "gemini":
        parts = [{"text": user}, *[{"inline_data": {"mime_type": m, "data": d}} for m, d in images]]
        body = {"contents": [{"role": "user", "parts": parts}], "generationConfig": {"temperature": provider.temperature, "maxOutputTokens": provider.max_tokens}}
        return body | ({"system_instruction": {"parts": [{"text": system}]}} if system else {})
    if provider.shape == "ollama":
        messages = [{"role": "user", "content": user} | ({"images": [d for _, d in images]} if images else {})]
        if system:
            messages.insert(0, {"role": "system", "content": system})
        return {"model": model, "messages": messages, "stream": False, "options": {"temperature": provider.temperature}}
    content: str | list = user
    if images:
        content = [{"type": "text", "text": user}, *[{"type": "image_url", "image_url": {"url": f"data:{m};base64,{d}"}} for m, d in images]]
    messages = [{"role": "system", "content": system}] if system else []
    return {"model": model, "messages": [*messages, {"role": "user", "content": content}], "temperature": provider.temperature, "max_tokens": provider.max_tokens}


def answer_of(shape: str, body: dict) -> tuple[str, dict]:
    """Text and usage object of a provider's answer."""
    if shape == "anthropic":
        return "".join(p.get("text", "") for p in body.get("content", [])), body.get("usage", {})
    if shape == "gemini":
        parts = body["candidates"][0]["content"]["parts"]
        used = body.get("usageMetadata", {})
        names = (("promptTokenCount", "prompt_token_count"), ("candidatesTokenCount", "candidates_token_count"), ("totalTokenCount", "total_token_count"))
        return "".join(p.get("text", "") for p in parts), {new: used[old] for old, new in names if old in used}
    if shape == "ollama":
        return body["message"]["content"], {"prompt_tokens": body.get("prompt_eval_count", 0), "completion_tokens": body.get("eval_count", 0)}
    return body["choices"][0]["message"]["content"], body.get("usage", {})


def http_call(providers: dict[str, tuple[Provider, str]], system: str = "") -> Callable[[dict], tuple[str, str]]:
    """A caller for answers.ask: requests name their model; providers: model name to (provider, the provider's
    name of it) (O-S13). An error status is raised with its number, so that a rate limit is retried."""

    def call(request: dict) -> tuple[str, str]:
        provider, name = providers[request["model"]]
        body = json.dumps(payload(provider, name, system, request["prompt"])).encode()
        headers = {"Content-Type": "application/json"}
        if provider.key:
            headers |= {"x-api-key": provider.key, "anthropic-version": "2023-06-01"} if provider.shape == "anthropic" else {"Authorization": f"Bearer {provider.key}"}
        try:
            with urllib.request.urlopen(urllib.request.Request(provider.url, body, headers), timeout=provider.timeout) as got:
                text, usage = answer_of(provider.shape, json.load(got))
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"status {e.code}") from e
        return text, json.dumps(usage)

    return call
