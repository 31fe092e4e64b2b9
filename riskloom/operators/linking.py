"""Mentions and links of articles: extraction from texts and metadata, the fuzzy linker, and expansion through the catalog.

Links are found once for each distinct set of base links (those that mentions, part numbers and metadata give), since many
articles share one: articles carry the key of their set, and the expansion runs over sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.fuzzy import partial_pairs
from riskloom.functions.metadata import place_rows
from riskloom.operators.catalog import MAX_COMPONENTS, MAX_SUPPLIERS, location_matches
from riskloom.plans.lineage import saved, spread

# Confidence of mentions, scores of links, and thresholds.
KNOWN, IN_METADATA = 0.85, 0.92
MANUFACTURER_LEAST, CANDIDATE_LEAST, CANDIDATES, REVIEW_BELOW = 75.0, 60.0, 5, 0.7
SCORES = {"exact_supplier_code": 1.0, "exact_mpn": 1.0, "metadata": 0.93, "keyword_location": 0.8, "supplier_manufacturer_map": 0.62, "supplier_inventory_map": 0.62, "manufacturer_catalog_map": 0.60, "location_supplier_map": 0.6, "location_manufacturer_map": 0.58}
MOST_BY_SUPPLIER = 0.9
COLUMNS = ["type", "canonical", "name", "score", "method", "text", "review"]


def metadata_places(articles: DataFrame) -> DataFrame:
    """(article_id, label, source, ordinal): the places that each article's metadata name, in their order."""
    return place_rows(articles, "article_id")


def extracted(known: DataFrame, places: DataFrame) -> DataFrame:
    """(article_id, text, type, canonical, confidence): mentions known from the text, and the places of the metadata that the text doesn't
    name so already. known has text, the mention in small letters."""
    own = known.select("article_id", "text", "type", "canonical", F.lit(KNOWN).alias("confidence"))
    told = places.select("article_id", F.lower("label").alias("text"), F.lit("LOCATION").alias("type"), F.col("label").alias("canonical"), F.lit(IN_METADATA).alias("confidence"))
    # two entities of one text and type are one mention: the text's own comes first, of several of those the least name
    rank = F.struct("confidence", "canonical")
    return own.unionByName(told).groupBy("article_id", "text", "type").agg(F.min(rank).alias("r")).select("article_id", "text", "type", "r.canonical", "r.confidence")


def fuzzy_manufacturers(surfaces: DataFrame, manufacturers: DataFrame, least: float = MANUFACTURER_LEAST) -> DataFrame:
    """(text, name, score, rank): for each surface (text, in small letters) the CANDIDATES manufacturers most like it by partial ratio, best
    first, of several the least name, with a ratio of at least least. Names differ in more than case."""
    names = manufacturers.where("name <> ''").groupBy(F.lower("name").alias("b")).agg(F.min("name").alias("name"))
    pairs = partial_pairs(surfaces.select("text"), names.select(F.col("b").alias("text")), least).join(names, "b")
    order = Window.partitionBy("text").orderBy(F.desc("score"), "name")
    return pairs.select(F.col("a").alias("text"), "name", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES)


def candidates(mentions: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """As fuzzy_manufacturers for the distinct manufacturer mentions, down to CANDIDATE_LEAST: what a model would be shown."""
    return fuzzy_manufacturers(mentions.where("type = 'MANUFACTURER'").select("text").distinct(), manufacturers, CANDIDATE_LEAST)


def _link(kind: str, canonical: Column, name: Column, method: str | Column, text: Column, score: Column | None = None, review: Column | bool = False) -> list[Column]:
    score = F.lit(SCORES[method]) if score is None else score
    return [F.lit(kind).alias("type"), canonical.alias("canonical"), name.alias("name"), score.alias("score"), (F.lit(method) if isinstance(method, str) else method).alias("method"), text.alias("text"), (F.lit(review) if isinstance(review, bool) else review).alias("review")]


def base_links(mentions: DataFrame, part_numbers: DataFrame, places: DataFrame, suppliers: DataFrame, manufacturer_suppliers: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """(article_id, *COLUMNS): links of mentions (see extracted), of part numbers (article_id, mpn), and of metadata places that no link names.
    manufacturer_suppliers: (manufacturer, code), of which the first MAX_SUPPLIERS count. Location ids are in small letters."""
    made = mentions.where("type = 'MANUFACTURER'").select("article_id", "text")
    best = saved(fuzzy_manufacturers(made.select("text").distinct(), manufacturers).where("rank = 1").select("text", "name", (F.col("score") / 100.0).alias("best")))
    named = made.join(best, "text")
    links = named.select("article_id", *_link("MANUFACTURER", F.col("name"), F.col("name"), "fuzzy_manufacturer", F.col("text"), F.col("best"), F.col("best") < REVIEW_BELOW))
    first = Window.partitionBy("manufacturer").orderBy("code")
    of = saved(manufacturer_suppliers.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= MAX_SUPPLIERS))
    via = named.join(of.withColumnRenamed("manufacturer", "name"), "name")
    links = links.unionByName(via.select("article_id", *_link("SUPPLIER", F.col("code"), F.col("code"), "manufacturer_supplier_map", F.col("text"), F.least("best", F.lit(MOST_BY_SUPPLIER)))))
    coded = mentions.where("type = 'SUPPLIER'").select("article_id", "text", F.upper("text").alias("code")).join(suppliers.select("code"), "code", "left_semi")
    links = links.unionByName(coded.select("article_id", *_link("SUPPLIER", F.col("code"), F.col("code"), "exact_supplier_code", F.col("text"))))
    at = mentions.where("type = 'LOCATION'").select("article_id", "text", F.col("canonical").alias("place"))
    links = links.unionByName(at.select("article_id", *_link("LOCATION", F.col("text"), F.col("place"), "keyword_location", F.col("text"))))
    links = links.unionByName(part_numbers.select("article_id", *_link("COMPONENT", F.col("mpn"), F.col("mpn"), "exact_mpn", F.col("mpn"))))
    missing = places.withColumn("key", F.lower("label")).join(at.select("article_id", F.col("text").alias("key")).hint("merge"), ["article_id", "key"], "left_anti")
    return links.unionByName(missing.select("article_id", *_link("LOCATION", F.col("key"), F.col("label"), F.col("source"), F.col("label"), F.lit(SCORES["metadata"]))))


def best_of(links: DataFrame, *keys: str) -> DataFrame:
    """One link per entity and type within keys: the best score; of several the least method, text and name."""
    rank = F.struct((-F.col("score")).alias("s"), "method", "text", "name", "review")
    return links.groupBy(*keys, "type", "canonical").agg(F.min(rank).alias("b")).select(*keys, "type", "canonical", "b.name", (-F.col("b.s")).alias("score"), "b.method", "b.text", "b.review")


def link_sets(links: DataFrame, key: str = "article_id", kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, set_id) and (set_id, *COLUMNS): the distinct sets of the keys' base links. kind: a column of links, one value for a key, by which equal
    sets are told apart; the sets have it too."""
    own = [kind] if kind else []
    gathered = best_of(links, key, *own).groupBy(key, *own).agg(F.array_sort(F.collect_list(F.struct(*COLUMNS))).alias("base"))
    keyed = saved(gathered.select(key, *own, F.md5(F.concat(*[F.col(c).cast("string") for c in own], F.to_json("base"))).alias("set_id"), "base"))
    one = spread(keyed, "set_id").groupBy("set_id", *own).agg(F.first("base").alias("base"))  # equal by their digest
    return keyed.select(key, "set_id"), one.select("set_id", *own, F.explode("base").alias("l")).select("set_id", *own, "l.*")


def expand(base: DataFrame, suppliers: DataFrame, manufacturers: DataFrame, parts: DataFrame, stock: DataFrame, key: str = "set_id") -> DataFrame:
    """base (key, *COLUMNS) with what the catalog adds: suppliers and manufacturers of linked places, manufacturers of suppliers, and the first
    MAX_COMPONENTS components (by mpn) of suppliers and manufacturers, those of suppliers first; one link per entity. suppliers: (code, name,
    country); manufacturers: (name, country); parts: (mpn, manufacturer); stock: (code, mpn, manufacturer)."""
    place = base.where("type = 'LOCATION'").select(key, F.col("name").alias("location")).distinct()
    at = place.select("location").distinct()

    def by_place(dim: DataFrame, column: str) -> DataFrame:
        return place.join(saved(location_matches(at, dim, column)), "location").groupBy(key, column).agg(F.min("location").alias("location"))

    named = saved(suppliers.groupBy("code").agg(F.min(F.coalesce("name", "code")).alias("name")))  # codes may be shared: the least name is the link's
    near = by_place(suppliers, "code").join(named, "code")
    links = base.unionByName(near.select(key, *_link("SUPPLIER", F.col("code"), F.col("name"), "location_supplier_map", F.col("location"), review=True)))
    makers = by_place(manufacturers.select(F.col("name").alias("maker"), "country"), "maker")
    links = links.unionByName(makers.select(key, *_link("MANUFACTURER", F.col("maker"), F.col("maker"), "location_manufacturer_map", F.col("location"), review=True)))
    sold = saved(stock.where("manufacturer <> ''").select("code", F.col("manufacturer").alias("maker")).distinct())
    codes = links.where("type = 'SUPPLIER'").select(key, F.col("canonical").alias("code")).distinct()
    via = codes.join(sold, "code").groupBy(key, "maker").agg(F.min("code").alias("code"))
    links = saved(best_of(links.unionByName(via.select(key, *_link("MANUFACTURER", F.col("maker"), F.col("maker"), "supplier_manufacturer_map", F.col("code"), review=True))), key))
    # the first parts of a set are among the first of each of its holders, so each holder's catalog is cut before it is joined
    stocked = stock.select(F.lit("SUPPLIER").alias("type"), F.col("code").alias("canonical"), "mpn")
    listed = parts.where("manufacturer <> ''").select(F.lit("MANUFACTURER").alias("type"), F.col("manufacturer").alias("canonical"), "mpn")
    ranked = Window.partitionBy("type", "canonical").orderBy("mpn")
    catalog = stocked.unionByName(listed).withColumn("_r", F.dense_rank().over(ranked)).where(F.col("_r") <= MAX_COMPONENTS).drop("_r").distinct()
    # sets of links with the same suppliers and manufacturers have the same components, which are found once for each such group
    of_set = links.where("type in ('SUPPLIER', 'MANUFACTURER')").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("type", "canonical"))).alias("holders"))
    of_set = saved(of_set.select(key, F.md5(F.to_json("holders")).alias("group"), "holders"))
    holders = of_set.groupBy("group").agg(F.first("holders").alias("h")).select("group", F.explode("h").alias("h")).select("group", "h.*")
    source = F.struct((F.col("type") == "MANUFACTURER").alias("late"), F.col("canonical").alias("of"))
    found = holders.join(catalog.hint("merge"), ["type", "canonical"]).groupBy("group", "mpn").agg(F.min(source).alias("s"))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy("mpn"))).where(F.col("_r") <= MAX_COMPONENTS)
    capped = of_set.select(key, "group").join(saved(first.drop("_r")).hint("merge"), "group")
    method = F.when(F.col("s.late"), "manufacturer_catalog_map").otherwise("supplier_inventory_map")
    score = F.when(F.col("s.late"), SCORES["manufacturer_catalog_map"]).otherwise(SCORES["supplier_inventory_map"])
    inferred = capped.select(key, *_link("COMPONENT", F.col("mpn"), F.col("mpn"), method, F.col("s.of"), score, True))
    return best_of(links.unionByName(inferred), key)


def set_totals(links: DataFrame, distributors: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, n_links, link_score, supplier_risk): how many links, the best score, and the largest risk of the linked suppliers, null where none has any."""
    risk = distributors.where("risk > 0").select(F.lit("SUPPLIER").alias("type"), F.col("code").alias("canonical"), "risk")
    return links.join(risk, ["type", "canonical"], "left").groupBy(key).agg(F.count("*").cast("int").alias("n_links"), F.max("score").alias("link_score"), F.max("risk").alias("supplier_risk"))


def uncovered(mentions: DataFrame, links: DataFrame, key: str = "article_id") -> DataFrame:
    """Mentions of articles (or sets) that no link of theirs was found by: those that a model would be asked for. links: (key, text)."""
    return mentions.join(links.select(key, F.lower("text").alias("text")).distinct(), [key, "text"], "left_anti")
