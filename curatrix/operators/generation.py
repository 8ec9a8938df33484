"""Text generation by an injected client; nothing here reaches a network by itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: prompts, model -> (text, input tokens, output tokens) of each.
Client = Callable[[list[str], str], list[tuple[str, int, int]]]
RETRYABLE = ("429", "500", "502", "503", "529", "overloaded", "rate limit", "timeout", "timed out", "unavailable")


def retryable(error: Exception) -> bool:
    said = str(error).lower()
    return any(x in said for x in RETRYABLE)


def with_retries(call: Callable[[], list], attempts: int = 3, wait: float = 2.0):
    """The call's result; retryable errors are tried again after growing pauses."""
    for n in range(attempts + 1):
        try:
            return call()
        except Exception as error:
            if n == attempts or not retryable(error):
                raise
            time.sleep(wait * 4**n * (1 + random.random() / 4))


def plain_schema(schema):
    """A JSON schema without type lists that allow null: their first other type stays."""
    if isinstance(schema, dict):
        out = {k: plain_schema(v) for k, v in schema.items()}
        if isinstance(out.get("type"), list):
            out["type"] = next((t for t in out["type"] if t != "null"), "string")
        return out
    return [plain_schema(x) for x in schema] if isinstance(schema, list) else schema


def generated(prompts: DataFrame, client: Client, model: str, fallback: str | None = None, structured: str | None = None, batch: int = 16, wait: float = 2.0) -> DataFrame:
    """prompts(..., prompt) with text, model, input_tokens, output_tokens, and with `structured` (a Spark type) the parsed text.

    A structured answer that doesn't parse is asked for once from the fallback model; one that still
    doesn't is null. Null prompts get null texts and cost nothing.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def parses(text: str | None) -> bool:
        import json

        try:
            json.loads(text or "")
        except ValueError:
            return False
        return True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].copy()
                asked = [j for j, p in enumerate(part.prompt) if p is not None]
                texts = part.prompt.tolist()
                got: list[tuple] = [(None, model, 0, 0)] * len(part)
                if asked:
                    for j, (t, a, b) in zip(asked, with_retries(lambda: client([texts[j] for j in asked], model), wait=wait), strict=True):
                        got[j] = (t, model, a, b)
                again = [j for j in asked if structured and fallback and not parses(got[j][0])]
                if again:
                    for j, (t, a, b) in zip(again, client([texts[j] for j in again], fallback), strict=True):
                        got[j] = (t, fallback, a, b)
                for c, name in enumerate(("text", "model", "input_tokens", "output_tokens")):
                    part[name] = [g[c] for g in got]
                yield part

    out = prompts.mapInPandas(run, f"{schema}, text string, model string, input_tokens bigint, output_tokens bigint")
    return out.withColumn("parsed", F.from_json("text", structured)) if structured else out
