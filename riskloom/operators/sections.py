"""Sections of supply-chain links as they are stored and shown: ordered lists of entries (id, name), each name once, case aside.

Entries travel as rows with their place; of a key's entries of one name the first is found by a grouped minimum, and only what stays is
nested, so an event may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import labels, mpn_of
from riskloom.operators.linking import expand, link_sets
from riskloom.plans.lineage import saved

SECTIONS = ("components", "distributors", "manufacturers", "affected_manufacturers", "locations")
SECTION_OF = {"COMPONENT": "components", "SUPPLIER": "distributors", "MANUFACTURER": "manufacturers", "LOCATION": "locations"}
PREFIX = {"COMPONENT": "MPN:", "SUPPLIER": "", "MANUFACTURER": "MFR:", "LOCATION": "LOC:"}
STORED, LINKED, TOLD = 0, 1, 2  # groups of entries, in their order
ENTRY = ["section", "part", "place", "k", "id", "name"]


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def linked_entries(links: DataFrame, key: str) -> DataFrame:
    """(key, *ENTRY) of link rows (key, type, canonical, name), in the order of their ids; a name that is the literal of a list is several."""
    kind = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("type")]
    rows = links.where(F.col("type").isin(*SECTION_OF) & (F.col("canonical") != "")).select(key, kind(SECTION_OF).alias("section"), F.concat(kind(PREFIX), "canonical").alias("id"), F.coalesce(F.nullif("name", F.lit("")), "canonical").alias("name"))
    shown = F.when(F.col("section") == "components", F.array("name")).otherwise(labels(F.col("name")))
    return rows.select(key, "section", F.lit(LINKED).alias("part"), F.lit(0).alias("place"), "id", F.posexplode(shown).alias("k", "name")).select(key, *ENTRY)


def told_entries(analyses: DataFrame, key: str) -> DataFrame:
    """(key, *ENTRY) of the manufacturers that analyses (key, skipped, affected) name; a skipped one names none."""
    names = analyses.where(~F.coalesce("skipped", F.lit(False))).select(key, F.posexplode("affected").alias("place", "raw"))
    return names.select(key, "place", F.posexplode(labels(F.col("raw"))).alias("k", "name")).select(key, F.lit("affected_manufacturers").alias("section"), F.lit(TOLD).alias("part"), "place", "k", F.concat(F.lit("ai_mfr:"), slug(F.col("name"))).alias("id"), "name")


def stored_entries(stored: DataFrame, key: str) -> DataFrame:
    """(key, *ENTRY) of stored sections: a row for each key with an array of structs (id, name) for some of SECTIONS."""
    each = [stored.select(key, F.lit(s).alias("section"), F.lit(STORED).alias("part"), F.posexplode(s).alias("place", "e")).select(key, "section", "part", "place", F.lit(0).alias("k"), "e.id", "e.name") for s in SECTIONS if s in stored.columns]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.trim("id"))
    return found.where(F.col("section").isin("components") | (name != "")).withColumn("name", F.when(F.col("section") == "components", F.col("name")).otherwise(name))


def by_id() -> Column:
    """Links have no place of their own, so they go by their ids."""
    return F.when(F.col("part") == LINKED, F.coalesce("id", F.lit(""))).otherwise("").alias("by_id")


def first_of_each(entries: DataFrame, key: str, same: Column | None = None) -> DataFrame:
    """The first entry of each name (or of each value of same), case aside, in a key's section; one without id is named after itself."""
    named = F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.col("id")).otherwise(F.concat(F.lit("name:"), slug(F.col("name"))))
    rank = F.struct("part", "place", by_id(), "k", named.alias("id"), "name")
    return entries.groupBy(key, "section", F.lower(F.col("name") if same is None else same).alias("_same")).agg(F.min(rank).alias("f")).select(key, "section", *[f"f.{c}" for c in ENTRY[1:]])


def preferred(entries: DataFrame, key: str) -> DataFrame:
    """Of each section the stored entries, or where none are the linked ones."""
    return entries.join(entries.groupBy(key, "section").agg(F.min("part").alias("part")), [key, "section", "part"])


def component_entries(entries: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Entries of components, each part number once, named by the catalog's description (parts: mpn, description), else by the number; a
    stored name that is more than the number stays."""
    mpn = mpn_of(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.trim("name")))
    rows = entries.withColumn("mpn", mpn).where("mpn <> ''")
    known = parts.groupBy("mpn").agg(F.min(F.nullif(F.trim("description"), F.lit(""))).alias("description"))
    own = F.trim(F.coalesce("name", F.lit("")))
    keeps = (F.col("part") == STORED) & (own != "") & (F.lower(own) != F.lower("mpn")) & ~F.startswith(F.upper(own), F.lit("MPN:"))
    rows = rows.join(known, "mpn", "left").withColumns({"id": F.concat(F.lit("MPN:"), "mpn"), "name": F.when(keeps, own).otherwise(F.coalesce("description", "mpn"))})
    return first_of_each(rows, key, F.col("mpn"))


def link_sections(keys: DataFrame, links: DataFrame, stored: DataFrame, analyses: DataFrame, parts: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, *SECTIONS), arrays of structs (id, name) in order, for every row of keys. A section is the stored one, or where that is empty the
    one of the links; affected manufacturers are those stored, then the manufacturers, then those that the analysis names."""
    entries = stored_entries(stored, key).unionByName(linked_entries(links, key))
    plain = preferred(entries.where("section in ('distributors', 'manufacturers', 'locations')"), key)
    shown = first_of_each(plain.where(F.col("part") == LINKED), key).unionByName(plain.where(F.col("part") == STORED).select(key, *ENTRY))
    made = shown.where("section = 'manufacturers'").withColumns({"section": F.lit("affected_manufacturers"), "part": F.lit(LINKED)})
    affected = first_of_each(entries.where("section = 'affected_manufacturers'").unionByName(made).unionByName(told_entries(analyses, key)), key)
    whole = shown.unionByName(affected).unionByName(component_entries(preferred(entries.where("section = 'components'"), key), parts, key))
    of = F.struct("part", "place", by_id(), "k", "id", "name")
    in_order = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, of))), lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name")))
    nested = whole.groupBy(key).agg(*[in_order(s).alias(s) for s in SECTIONS])
    none = F.array().cast("array<struct<id: string, name: string>>")
    return keys.select(key).join(nested, key, "left").select(key, *[F.coalesce(s, none).alias(s) for s in SECTIONS])


def names_of(section: str) -> Column:
    """The labels of a section's entries, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(section, lambda e: labels(F.coalesce(F.nullif(e["name"], F.lit("")), e["id"])))))


def backfilled(links: DataFrame, events: DataFrame, suppliers: DataFrame, manufacturers: DataFrame, parts: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, set_id) and (set_id, link columns): stored links (event_id, link columns) as they are for events (event_id, stored) that
    were stored whole, and expanded through the catalog for the legacy ones, once for each distinct set of links."""

    told = links.join(events.where("stored is not null").select("event_id", "stored").hint("merge"), "event_id")
    of_events, sets = link_sets(told, "event_id", "stored")
    sets = saved(sets)
    whole, base = sets.where("stored").drop("stored"), sets.where("not stored").drop("stored")
    return of_events, whole.unionByName(expand(base, suppliers, manufacturers, parts, stock).select(whole.columns))
