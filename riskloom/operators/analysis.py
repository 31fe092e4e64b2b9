"""The boundary to a language model: what it is shown, how it is called, and answers read back as typed rows.

The call itself is a function from contexts to answers, given by the user, and runs in batches where the rows lie; without one no event is
analysed. Answers are untrusted text: they may be fenced, broken, of wrong types, or name entities that aren't there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metadata as M
from riskloom.functions.text import labels, strip_fences

# Fields of an answer, and the entity types that a match may have.
TEXTS = ("executive_summary", "business_impact", "short_term_impact", "long_term_impact", "confidence_explanation")
LISTS = ("affected_industries", "affected_manufacturers", "possible_consequences", "supply_chain_implications", "monitoring_actions")
TYPES = ("SUPPLIER", "MANUFACTURER", "COMPONENT", "LOCATION", "ORGANIZATION", "FACILITY", "EVENT_PHRASE")
MOST_URLS = 5


def contexts(events: DataFrame, columns: list[str], urls: str | None = None) -> DataFrame:
    """(event_id, context): the columns of each event as JSON, of its urls the first MOST_URLS."""
    shown = [F.slice(c, 1, MOST_URLS).alias(c) if c == urls else F.col(c) for c in columns]
    return events.select("event_id", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("context"))


def ask(asked: DataFrame, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(event_id, content): the model's answer to each context, null where it has none. A batch whose call fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = list(model(batch["context"].tolist()))
            except Exception:  # noqa: BLE001 the model is the user's; its failures are rows without answers
                answers = [None] * len(batch)
            yield pd.DataFrame({"event_id": batch["event_id"], "content": pd.Series(answers, index=batch.index, dtype="object")})

    return asked.select("event_id", "context").mapInPandas(run, f"event_id {asked.schema['event_id'].dataType.simpleString()}, content string")


def _object(content: Column) -> Column:
    value = F.try_parse_json(strip_fences(content))
    return F.when(M.kind_of(value) == "OBJECT", value)


def _texts(value: Column) -> Column:
    many = F.try_variant_get(value, "$", "array<variant>")
    told = F.transform(many, lambda v: F.when(M.kind_of(v).isin("OBJECT", "ARRAY"), "").otherwise(F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))))
    return F.coalesce(F.filter(told, lambda t: t != ""), F.array().cast("array<string>"))


def analyses(answers: DataFrame) -> DataFrame:
    """(event_id, readable, TEXTS, LISTS, analysis_confidence) of answers (event_id, content). A missing text is empty, what is no list is an
    empty one, blank and nested items go, and a confidence that is no number is 0; numbers are clamped to 0 and 1. An answer that is no JSON
    object is not readable and has only such empty values."""
    rows = answers.withColumn("_o", _object(F.col("content")))
    at = lambda name: F.try_variant_get("_o", f"$.{name}", "variant")
    text = lambda name: F.trim(F.coalesce(F.try_variant_get("_o", f"$.{name}", "string"), F.lit(""))).alias(name)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(M.number(at("analysis_confidence")), F.lit(0.0)))).alias("analysis_confidence")
    return rows.select("event_id", F.col("_o").isNotNull().alias("readable"), *[text(n) for n in TEXTS], *[_texts(at(n)).alias(n) for n in LISTS], sure)


def matches(answers: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, type, canonical, name, score, method, text, review) of the links that answers (key, content) propose: those with an id, a name, a
    known type and the text they were found by, unresolved ones left out; a score that is no number is 0.8."""
    rows = answers.withColumn("_o", _object(F.col("content"))).select(key, F.explode(F.try_variant_get("_o", "$.matches", "array<variant>")).alias("m")).where(M.kind_of(F.col("m")) == "OBJECT")
    text = lambda name: F.trim(F.try_variant_get("m", f"$.{name}", "string"))
    found = rows.select(key, text("entity_type").alias("type"), text("canonical_id").alias("canonical"), text("canonical_name").alias("raw"), F.coalesce(M.number(F.try_variant_get("m", "$.match_score", "variant")), F.lit(0.8)).alias("score"), F.lit("llm").alias("method"), text("extracted_text").alias("text"), F.coalesce(F.try_variant_get("m", "$.requires_review", "boolean"), F.lit(False)).alias("review"))
    whole = found.where(F.col("type").isin(*TYPES) & (F.col("canonical") != "") & (F.col("canonical") != "UNRESOLVED") & (F.col("raw") != "") & (F.col("text") != ""))
    return whole.withColumn("name", F.coalesce(F.get(labels(F.col("raw")), 0), "raw")).select(key, "type", "canonical", "name", "score", "method", "text", "review")
