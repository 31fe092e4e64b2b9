"""Provider payloads (landed JSON) to one article schema. Dates that can't be read are null; rows without a key are dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.lexicon import PROVIDERS
from riskloom.functions.text import lookup

SCHEMAS = {
    "gdacs": "features array<struct<properties: struct<eventid: bigint, eventtype: string, name: string, alertlevel: string, country: string, fromdate: string, severitydata: struct<severity: double, severitytext: string>, url: struct<report: string>>>>",
    "gdelt": "data array<struct<title: string, name: string, headline: string, summary: string, description: string, body: string, text: string, url: string, published_at: string, category: string, event_code: string, subcategory: string, geo: struct<country: string, latitude: double, longitude: double>>>",
    "marketaux": "data array<struct<uuid: string, title: string, description: string, url: string, published_at: string, sentiment: double, entities: array<struct<sentiment_score: double>>>>",
    "gnews": "articles array<struct<title: string, description: string, url: string, publishedAt: string, source: struct<name: string>>>",
    "newsdata": "results array<struct<title: string, description: string, link: string, pubDate: string, language: string>>",
}


def parse_time(text: Column) -> Column:
    """ISO 8601 with or without Z, or seconds since 1970."""
    return F.when(text.rlike("^[0-9]{9,11}$"), F.timestamp_seconds(text.try_cast("long"))).otherwise(F.try_to_timestamp(text))


def first_of(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def mean_sentiment(entities: str, fallback: str) -> Column:
    """Mean of the entities' scores that are known; the record's own where it has no entities."""
    known = F.filter(F.transform(entities, lambda e: e["sentiment_score"]), lambda s: s.isNotNull())
    return F.when(F.size(entities) > 0, F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, s: a + s) / F.size(known))).otherwise(F.col(fallback))


def normalize(provider: str, raw: DataFrame, limit: int | None = None) -> DataFrame:
    """article_id, provider, tier, title, body, url, published_at, sentiment, gdacs_type, alert_level, magnitude, category, event_code, subcategory, geo_country."""
    rows = raw.select(F.explode(raw.columns[0]).alias("r")).select("r.properties.*" if provider == "gdacs" else "r.*")
    rows = rows.limit(limit) if limit else rows
    text = {"title": F.col("title") if "title" in rows.columns else None, "body": F.col("description") if "description" in rows.columns else None}
    more: dict[str, Column] = {}
    if provider == "gdacs":
        rows = rows.where("eventid is not null")
        text = {"title": F.col("name"), "body": F.concat_ws(". ", "name", F.concat(F.lit("Alert level: "), "alertlevel"), "severitydata.severitytext")}
        more = {"key": F.col("eventid").cast("string"), "url": F.col("url.report"), "at": F.col("fromdate"), "gdacs_type": F.col("eventtype"), "alert_level": F.col("alertlevel"), "magnitude": F.col("severitydata.severity"), "geo_country": F.col("country")}
    elif provider == "gdelt":
        text = {"title": first_of("title", "name", "headline", "summary"), "body": first_of("description", "summary", "body", "text")}
        more = {"key": first_of("url", "title"), "at": F.col("published_at"), "category": F.col("category"), "event_code": F.col("event_code"), "subcategory": F.col("subcategory"), "geo_country": F.col("geo.country")}
    elif provider == "marketaux":
        more = {"key": first_of("uuid", "url"), "at": F.col("published_at"), "sentiment": mean_sentiment("entities", "sentiment")}
    elif provider == "gnews":
        more = {"key": F.col("url"), "at": F.col("publishedAt")}
    elif provider == "newsdata":
        more = {"key": F.col("link"), "url": F.col("link"), "at": F.col("pubDate")}
    else:
        raise ValueError(f"unknown provider {provider}")
    none = F.lit(None).cast("string")
    return rows.select(
        F.concat_ws(":", F.lit(provider), more["key"]).alias("article_id"), F.lit(provider).alias("provider"), lookup(F.lit(provider), {p: v[0] for p, v in PROVIDERS.items()}, 3).alias("tier"), F.coalesce(text["title"], F.lit("")).alias("title"), F.coalesce(text["body"], F.lit("")).alias("body"),
        (more["url"] if "url" in more else F.col("url")).alias("url"), parse_time(more["at"]).alias("published_at"), more.get("sentiment", F.lit(None).cast("double")).cast("double").alias("sentiment"), more.get("magnitude", F.lit(None).cast("double")).alias("magnitude"),
        *[more.get(c, none).alias(c) for c in ("gdacs_type", "alert_level", "category", "event_code", "subcategory", "geo_country")],
    )


def ingest(spark: SparkSession, paths: dict[str, str], limit: int | None = None) -> DataFrame:
    """All providers' landed files as one relation; unknown names are skipped."""
    found = [normalize(p, spark.read.schema(SCHEMAS[p]).json(path, multiLine=True), limit) for p, path in paths.items() if p in SCHEMAS]
    return reduce(DataFrame.unionByName, found)
