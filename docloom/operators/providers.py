"""Providers that fill fields which rules have left open, and what they cost."""

from __future__ import annotations

import time
from collections.abc import Iterable
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.ship import ship

#: Tries of a call, and the longest pause between two in seconds.
TRIES, PAUSE = 3, 8.0
#: Dollars for a million tokens, in and out.
RATES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00)}
FOUND = "doc_id string, field string, value string, confidence double, span string, page int, prompt_tokens long, completion_tokens long, error string"


@runtime_checkable
class Provider(Protocol):
    """What fill() calls in its tasks; it must be picklable. There is none by default, so rules alone decide."""

    name: str
    model: str

    def available(self) -> bool: ...

    def extract_field(self, text: str, field: str, description: str) -> Iterable[dict]:
        """Dicts with value, and optionally confidence, span, page, prompt_tokens and completion_tokens."""
        ...


def _call(provider: Provider, text: str, field: str, description: str, pause: float) -> tuple[list[dict], str | None]:
    error = None
    for n in range(TRIES):
        try:
            return list(provider.extract_field(text, field, description)), None
        except Exception as e:  # a failed call costs that field only
            error = f"{type(e).__name__}: {e}"[:500]
            if n + 1 < TRIES:
                time.sleep(min(pause, 0.5 * 2**n))
    return [], error


def fill(gaps: DataFrame, docs: DataFrame, specs: DataFrame, provider: Provider | None, pause: float = PAUSE) -> DataFrame:
    """What a provider finds for gaps (doc_id, field) in docs (doc_id, text); specs has field and description.

    Rows are doc_id, field, value, confidence, span, page, prompt_tokens,
    completion_tokens, error. A field whose calls all fail is one row with an
    error and no value. Without a provider that is available there are no rows.
    """
    spark = ship(gaps.sparkSession)
    if provider is None or not provider.available():
        return spark.createDataFrame([], FOUND)

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, field, text, description in zip(pdf["doc_id"], pdf["field"], pdf["text"], pdf["description"], strict=True):
                found, error = _call(provider, text or "", field, description or "", pause)
                for x in found or ([{}] if error else []):
                    rows.append((doc, field, x.get("value"), float(x.get("confidence", 0.5)), x.get("span"), x.get("page"), int(x.get("prompt_tokens", 0)), int(x.get("completion_tokens", 0)), error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"page": "Int32"})

    asked = gaps.join(docs.select("doc_id", "text"), "doc_id").join(F.broadcast(specs.select("field", "description")), "field")
    return asked.select("doc_id", "field", "text", "description").mapInPandas(run, FOUND)


def usage(found: DataFrame, model: str, by: list[str] | tuple = ()) -> DataFrame:
    """Calls, failed calls, tokens and cost in dollars of what fill() gave, in all or by columns."""
    rate_in, rate_out = RATES.get(model, (0.0, 0.0))
    cost = F.sum("prompt_tokens") / 1_000_000 * rate_in + F.sum("completion_tokens") / 1_000_000 * rate_out
    return found.groupBy(*by).agg(
        F.count_distinct("doc_id", "field").alias("calls"), F.count_distinct(F.when(F.col("error").isNotNull(), F.struct("doc_id", "field"))).alias("failed"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"), F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost_usd"),
    )
