"""Semi-structured provider metadata, read as VARIANT with guards on the types that stand there.

A provider's record lies under raw where that is an object, else the metadata are the record. Places are looked for in a fixed
order of paths; a value may be a text, a number, a list (of lists) or the literal of a list in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import geo_label, label_part, labels

# Paths of places, in their order, and of market metrics.
GEO_PATHS = ("country", "admin1", "location")
METRICS = ("market_sensitivity", "systemic_importance", "propagation_potential")


def kind_of(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def parsed(df: DataFrame) -> DataFrame:
    """df (metadata, JSON text) with the VARIANT columns that the functions below read: _whole, the _record in it, and the record's _geo and
    _metrics, each null where it is no object. They stand as columns, so that nothing is parsed twice."""
    of_kind = lambda v: F.when(kind_of(v) == "OBJECT", v)
    df = df.withColumn("_json", F.try_parse_json("metadata")).withColumn("_whole", of_kind(F.col("_json")))
    df = df.withColumn("_raw", _at(F.col("_whole"), "$.raw")).withColumn("_record", F.coalesce(of_kind(F.col("_raw")), "_whole"))
    df = df.withColumns({"_geo0": _at(F.col("_record"), "$.geo"), "_metrics0": _at(F.col("_record"), "$.metrics")})
    return df.withColumns({"_geo": of_kind(F.col("_geo0")), "_metrics": of_kind(F.col("_metrics0"))}).drop("_json", "_raw", "_geo0", "_metrics0")


def unparsed(df: DataFrame) -> DataFrame:
    return df.drop("_whole", "_record", "_geo", "_metrics")


def _text(value: Column) -> Column:
    """Of a scalar: texts as they are, numbers in their shortest form, truth values in capitals' case."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind_of(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def place_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, label, source, ordinal) of the frame (key, metadata): the places that the metadata name, each once, case aside, numbered in the
    order of the paths. Labels of one letter are left out; an object is no label. Values become rows before they are cleaned, so that
    all of it is plain columns."""
    whole, record, geo = F.col("_whole"), F.col("_record"), F.col("_geo")
    filled = lambda v: F.when((kind_of(v) != "VOID") & ~F.coalesce(F.try_variant_get(v, "$", "string").isin("", "0", "false"), F.lit(False)), v)
    entry = lambda e: F.when(kind_of(e) == "OBJECT", F.coalesce(filled(_at(e, "$.countryname")), _at(e, "$.country"))).otherwise(e)
    named = lambda value, source: F.struct(F.lit(source).alias("source"), value.alias("value"))
    affected = F.try_variant_get(record, "$.affected_countries", "array<variant>")
    paths = F.array(*[named(_at(geo, f"$.{p}"), f"geo.{p}") for p in GEO_PATHS], named(_at(record, "$.country"), "raw.country"), named(_at(whole, "$.country"), "provider.country"))
    more = F.transform(affected, lambda e: named(entry(e), "affected_countries"))
    values = parsed(df.where("metadata is not null").select(key, "metadata")).select(key, F.posexplode(F.when(more.isNull(), paths).otherwise(F.concat(paths, more))).alias("o", "v"))
    values = values.select(key, "o", "v.source", "v.value").where("value is not null").withColumn("many", F.try_variant_get("value", "$", "array<variant>"))
    items = values.select(key, "o", "source", F.posexplode(F.coalesce("many", F.array("value"))).alias("e", "item")).withColumn("kind", kind_of(F.col("item"))).where("kind not in ('OBJECT', 'VOID')")
    texts = items.select(key, "o", "source", "e", F.when(F.col("kind") == "ARRAY", F.to_json("item")).otherwise(_text(F.col("item"))).alias("text"))
    found = texts.select(key, "o", "source", "e", F.posexplode(labels(F.col("text"))).alias("k", "label")).where(F.length("label") >= 2)
    first = found.groupBy(key, F.lower("label").alias("_same")).agg(F.min(F.struct("o", "e", "k", "label", "source")).alias("f")).select(key, "f.*")
    return first.select(key, "label", "source", (F.row_number().over(Window.partitionBy(key).orderBy("o", "e", "k")) - 1).alias("ordinal"))


def number(value: Column) -> Column:
    return F.when(kind_of(value) == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), 1.0).otherwise(0.0)).when(~kind_of(value).isin("OBJECT", "ARRAY", "VOID"), F.trim(F.try_variant_get(value, "$", "string")).try_cast("double"))


def coordinates() -> tuple[Column, Column, Column, Column]:
    """Of a parsed frame (latitude, longitude, country, region): numbers that can't be read are null, names are cleaned for display; a missing country is
    that of the metadata themselves."""
    whole, geo = F.col("_whole"), F.col("_geo")

    def label(value: Column) -> Column:
        many = F.try_variant_get(value, "$", "array<variant>")
        part = lambda v: F.when(~kind_of(v).isin("OBJECT", "ARRAY"), label_part(_text(v)))
        joined = F.array_join(F.filter(F.array_compact(F.transform(many, part)), lambda x: x != ""), ", ")
        return F.nullif(F.when(many.isNotNull(), joined).when(kind_of(value) != "OBJECT", geo_label(_text(value))), F.lit(""))

    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.when(kind_of(v).isin("OBJECT", "ARRAY"), F.to_json(v)))
    own = _at(geo, "$.country")
    country = F.when(~F.coalesce(text(own).isin("", "0", "false", "[]", "{}"), F.lit(True)), own).otherwise(_at(whole, "$.country"))
    return number(_at(geo, "$.latitude")), number(_at(geo, "$.longitude")), label(country), label(_at(geo, "$.region"))


def market_metric() -> Column:
    """Of a parsed frame: the first metric that can be read as a number; null without one."""
    return F.coalesce(*[number(_at(F.col("_metrics"), f"$.{m}")) for m in METRICS])
