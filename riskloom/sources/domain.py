"""The risk model's relations over the driver's tables: catalog dimensions, articles and stored events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.lexicon import PROVIDERS
from riskloom.functions.metadata import coordinates, parsed, unparsed
from riskloom.functions.text import lookup, strings

TITLES = [
    "Port closure disrupts chip shipments from {N}", "Factory fire halts production at {B} plant in {N}", "Earthquake of magnitude 6.4 strikes {N}", "Export ban on semiconductor equipment announced in {N}",
    "Supplier {S} files for bankruptcy", "Labor dispute: strike and walkout at {B} foundry", "Ransomware attack and data breach at supplier {S}", "Football cup final draws a crowd in {N}",
    "Company picnic in {N}", "Grid failure and power outage hit wafer fab in Taiwan", "Shipping delay in the Red Sea affects cargo of {M}", "Embargo: full trade restriction against {N}",
    "Flood and flooding close roads in {N}", "Quarantine and lockdown in {N} delay components", "Semiconductor shortage lifts prices of {M}", "Armed conflict near {N} threatens lead time",
    "{B} opens a new research milestone office", "Credit downgrade for {B} after liquidity crisis", "Strait of Hormuz closure is a major risk for freight", "Import restriction: new compliance requirement in {N}",
    "Typhoon nears {N}, critical port shutdown expected", "Protest and demonstration at supplier {S} in {N}", "Suez Canal blockage partial, {B} shipments late", "Quarterly results of {B} announced",
]
BODY = "Reported from {N}: part {M} of {B} via {S}. Stock of {C}."
STOCKED = ["medium parts", "promo parts", "economy parts"]
GDACS_TYPES, GDACS_LEVELS = ["EQ", "FL", "TC", "VO", "DR", "WF", "XX"], ["Green", "Orange", "Red"]
GDELT_CATEGORIES, GDELT_CODES, GDELT_SUBS = ["CORPORATE", "CONFLICT", "PROTEST"], ["CO04", "IN02", "EX01", "PR01"], ["MILESTONE", "RIOT", "DEVELOPMENT", "STRIKE", "TALKS"]
#: Pieces of provider metadata; {N} stands for a nation and {n} for it in small letters.
GEO = [
    '{"country": "{N}", "admin1": "North", "location": "Port {N}"}', '{"country": ["{n}", "{N}", "Oman"], "latitude": 12.5, "longitude": "7"}', """{"country": "['{n}', 'west coast']"}""", '"nowhere"',
    '{"country": 42, "latitude": "x", "longitude": -3}', '{"country": null, "region": "middle east"}', '{"country": {"name": "{N}"}, "location": [["Muscat"], "muscat"]}', "{}",
]
COUNTRY = ['"{N}"', "null", '["Chile", "{n}"]']
METRICS = ['{"market_sensitivity": 0.9}', '{"market_sensitivity": "high", "systemic_importance": "0.4"}', "[]", '{"propagation_potential": 1}', '{"market_sensitivity": {}}']
AFFECTED = ['[{"countryname": "{N}"}, {"countryname": "", "country": "Peru"}, "Chile", 7, null]', "[]", '"none"', '[{"other": 1}]']
#: Answers of a model, {N} standing for a number.
ANSWERS = [
    '{"executive_summary": " Event {N} ", "affected_manufacturers": ["Acme", " ", "Maker {N}", 7], "analysis_confidence": 0.75}', '```json\n{"executive_summary": "fenced", "analysis_confidence": "1.5", "monitoring_actions": "watch"}\n```', '{"executive_summary": "cut',
    "[1, 2]", '{"business_impact": 12, "affected_manufacturers": [null, {"a": 1}, "x"], "analysis_confidence": {}}', "no answer", '{"analysis_confidence": -3, "possible_consequences": []}',
]
CATEGORIES = ["natural_disaster", "factory_shutdown", "export_sanction", "labor_action", "logistics_disruption", "financial_distress", "geopolitical_event", "cyber_incident", "energy_disruption", "other"]
STATUSES = ["detected", "updated", "escalated", "resolved"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.element_at(strings(values), (index + 1).cast("int"))


def distributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    dealt = F.when(F.col("s_suppkey") % 4 == 3, "no").when(F.col("s_suppkey") % 4 == 2, " TRUE ").otherwise("Yes")
    risk = F.when(F.col("s_acctbal") < 0, 0.9).when(F.col("s_acctbal") < 3000, 0.6).when(F.col("s_acctbal") < 6000, 0.3).otherwise(0.0)
    return s.select(F.concat(F.lit("SUP"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), dealt.alias("dealt_with"), risk.alias("risk"))


def manufacturers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    brands = table(spark, sf_dir, "part").where("p_brand is not null").select(F.col("p_brand").alias("name")).distinct()
    return brands.withColumn("k", F.regexp_extract("name", "([0-9]+)", 1).cast("int") % 25).join(nation, F.col("k") == F.col("n_nationkey"), "left").select("name", "country", F.replace("name", F.lit("#"), F.lit(" ")).alias("alias"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("MPN"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("mpn"), F.coalesce("p_brand", F.lit("")).alias("manufacturer"), F.coalesce(F.when(F.col("p_type").isin("MEDIUM", "PROMO"), F.concat(F.lower("p_type"), F.lit("__parts"))).otherwise(F.col("p_type")), F.lit("catalog")).alias("category"), F.col("p_name").alias("description"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    i = table(spark, sf_dir, "lineitem").join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return i.select(
        F.concat(F.lit("SUP"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0")).alias("code"), F.concat(F.lit("MPN"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")).alias("mpn"),
        F.abs(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) % 90).alias("lead_time_days"), F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
    )


def articles(spark: SparkSession, sf_dir: str, some: Callable[[DataFrame], DataFrame] = lambda e: e) -> DataFrame:
    """some: what is done to the events (event_id, ts, user_id, props) before the far wider articles are made of them."""
    e = some(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    provider = pick(list(PROVIDERS), u % 5)
    nation = F.concat(F.lit("NATION_"), (u % 25).cast("string"))
    fill = [("{N}", nation), ("{S}", F.concat(F.lit("SUP"), F.lpad((i % 10).cast("string"), 3, "0"))), ("{B}", F.concat(F.when(i % 2 == 0, "Brand#").otherwise("Brand "), (i % 25 + 1).cast("string"))), ("{C}", pick(STOCKED, i % 3)), ("{M}", F.concat(F.lit("MPN"), F.lpad((i % 50).cast("string"), 6, "0")))]

    def filled(text):
        for mark, value in fill:
            text = F.replace(text, F.lit(mark), value)
        return text

    def given(name, value):
        return F.when(provider == name, value)

    def placed(values, index):
        return F.replace(F.replace(pick(values, index), F.lit("{N}"), nation), F.lit("{n}"), F.lower(nation))

    more = F.concat(F.lit(', "geo": '), placed(GEO, i % 8), F.lit(', "country": '), placed(COUNTRY, i % 3), F.lit(', "metrics": '), pick(METRICS, i % 5), F.lit("}"))
    record = F.concat(F.format_string('{"category": "%s", "event_code": "%s", "subcategory": "%s"', pick(GDELT_CATEGORIES, k % 3), pick(GDELT_CODES, k % 4), pick(GDELT_SUBS, k % 5)), more)
    metadata = F.when(provider == "gdelt", F.when(k % 2 == 0, record).otherwise(F.concat(F.lit('{"raw": '), record, F.lit("}")))).when(provider == "gdacs", F.concat(F.lit('{"affected_countries": '), placed(AFFECTED, i % 4), more))
    found = e.select(
        i.alias("article_id"), provider.alias("provider"), lookup(provider, {n: p[0] for n, p in PROVIDERS.items()}, 3).alias("tier"), filled(pick(TITLES, i % 24)).alias("title"), filled(F.lit(BODY)).alias("body"), F.col("ts").alias("published_at"),
        F.when(i % 9 != 0, F.concat(F.lit("https://news.example/"), provider, F.lit("/"), (i % 700).cast("string"))).alias("url"),
        given("marketaux", (k - 60) / 100.0).alias("sentiment"), given("gdacs", pick(GDACS_TYPES, i % 7)).alias("gdacs_type"), given("gdacs", pick(GDACS_LEVELS, i % 3)).alias("alert_level"), given("gdacs", F.when(k % 4 != 0, (k % 80) / 10.0)).alias("magnitude"),
        given("gdelt", pick(GDELT_CATEGORIES, k % 3)).alias("category"), given("gdelt", pick(GDELT_CODES, k % 4)).alias("event_code"), given("gdelt", pick(GDELT_SUBS, k % 5)).alias("subcategory"), given("gdelt", (k % 10) / 10.0).alias("significance"),
        metadata.alias("metadata"),
    )
    return unparsed(parsed(found).withColumn("geo_country", coordinates()[2]))


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    return e.select(
        i.alias("event_id"), pick(CATEGORIES, (i % 7 + u % 4)).alias("event_category"), "event_type", F.concat(F.lit("Event "), (u % 40).cast("string"), F.lit(" of "), F.col("event_type")).alias("title"), F.concat(F.lit("Summary of "), F.col("event_type"), F.lit(" "), k.cast("string")).alias("summary"),
        F.least(F.lit(100.0), F.floor(F.col("value")).cast("double")).alias("severity"), ((k % 50) / 50.0).alias("class_confidence"), ((k % 20) / 20.0).alias("confidence"), ((u % 10) / 10.0).alias("verification"), (u % 4 + 1).cast("int").alias("source_count"),
        (k % 6).cast("int").alias("n_components"), F.concat(F.lit("SUP"), F.lpad((u % 10).cast("string"), 3, "0")).alias("supplier_code"), F.concat(F.lit("NATION_"), (u % 25).cast("string")).alias("geo_country"), F.when(u % 3 != 0, (u % 90).cast("double")).alias("latitude"), F.when(u % 3 != 0, (u % 180).cast("double")).alias("longitude"),
        pick(STATUSES, i % 4).alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").alias("retrieved_at"),
    )
