"""The catalog registry: suppliers, manufacturers and components with their links, and expansion of links through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import lexicon as L
from riskloom.functions.text import bounded, marked, word_runs
from riskloom.plans.lineage import saved

MAX_MPNS, MAX_SUPPLIERS, MAX_COMPONENTS = 500, 3, 100


def active(distributors: DataFrame) -> DataFrame:
    return distributors.where(F.lower(F.trim("dealt_with")).isin("yes", "y", "true", "1"))


def inventory_map(inventory: DataFrame, distributors: DataFrame, parts: DataFrame) -> DataFrame:
    """Stock of active suppliers with each part's manufacturer and category; of parts that share an mpn the least row counts."""
    return _with_parts(_active_stock(inventory, distributors), parts).select("code", "mpn", "manufacturer", "category", "lead_time_days", "quantity", "ordinal")


def holdings(inventory: DataFrame, distributors: DataFrame, parts: DataFrame) -> DataFrame:
    """The distinct (code, mpn, manufacturer, category) of inventory_map. Pairs are told apart where the parts are joined, by one exchange."""
    pairs = _active_stock(inventory.select("code", "mpn"), distributors).repartition("mpn").distinct()
    return _with_parts(pairs, parts).select("code", "mpn", "manufacturer", "category")


def _active_stock(inventory: DataFrame, distributors: DataFrame) -> DataFrame:
    return inventory.join(active(distributors).select("code").distinct(), "code", "left_semi").where("mpn is not null")


def _with_parts(stock: DataFrame, parts: DataFrame) -> DataFrame:
    """stock with manufacturer and category. Parts are hashed a partition at a time, so the far larger stock isn't sorted."""
    one = parts.groupBy("mpn").agg(F.min(F.struct("manufacturer", "category")).alias("p"))
    return stock.join(one.hint("shuffle_hash"), "mpn", "left").withColumns({"manufacturer": F.coalesce("p.manufacturer", F.lit("")), "category": F.coalesce("p.category", F.lit("catalog"))}).drop("p")


def _set(name: str) -> Column:
    return F.array_sort(F.collect_set(F.nullif(name, F.lit(""))))


def supplier_links(distributors: DataFrame, stock: DataFrame) -> DataFrame:
    sets = stock.groupBy("code").agg(_set("manufacturer").alias("manufacturers"), _set("category").alias("categories"), _set("mpn").alias("mpns"))
    none = F.array().cast("array<string>")
    return active(distributors).join(sets, "code", "left").select("code", "name", "country", "risk", *[F.coalesce(c, none).alias(c) for c in ("manufacturers", "categories", "mpns")])


def manufacturer_links(manufacturers: DataFrame, parts: DataFrame, stock: DataFrame) -> DataFrame:
    """Suppliers of each manufacturer, and the first MAX_MPNS of its mpns; distinct pairs are ranked, so no manufacturer's parts are gathered beyond the cap."""
    ranked = parts.select("manufacturer", "mpn").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("manufacturer").orderBy("mpn"))).where(F.col("rank") <= MAX_MPNS)
    mpns = ranked.groupBy("manufacturer").agg(F.array_sort(F.collect_list("mpn")).alias("mpns"))
    suppliers = stock.groupBy("manufacturer").agg(_set("code").alias("suppliers"))
    none = F.array().cast("array<string>")
    m = manufacturers.withColumnRenamed("name", "manufacturer")
    return m.join(mpns, "manufacturer", "left").join(suppliers, "manufacturer", "left").select("manufacturer", "country", F.coalesce("mpns", none).alias("mpns"), F.coalesce("suppliers", none).alias("suppliers"))


def components(parts: DataFrame, stock: DataFrame) -> DataFrame:
    """Each part with the supplier of its first stock row."""
    first = stock.groupBy("mpn").agg(F.min_by("code", F.struct("ordinal", "code")).alias("supplier"))
    return parts.join(first, "mpn", "left").select("mpn", "manufacturer", "category", F.coalesce("supplier", F.lit("")).alias("supplier"))


def countries(distributors: DataFrame, manufacturers: DataFrame) -> DataFrame:
    both = active(distributors).select("country").unionByName(manufacturers.select("country"))
    return both.where("country is not null and country <> ''").distinct()


def gazetteer(distributors: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """(surface, canonical, type): names and aliases by which catalog entities occur in texts, countries, regions and strategic locations."""
    named = lambda df, surface, canonical, kind: df.select(F.col(surface).alias("surface"), F.col(canonical).alias("canonical"), F.lit(kind).alias("type"))
    places = manufacturers.sparkSession.createDataFrame([(name,) for name in [*L.REGIONS, *L.LOCATIONS]], "country string")
    found = named(active(distributors), "code", "code", "SUPPLIER").unionByName(named(manufacturers, "name", "name", "MANUFACTURER")).unionByName(named(manufacturers, "alias", "name", "MANUFACTURER"))
    found = found.unionByName(named(countries(distributors, manufacturers).unionByName(places), "country", "country", "LOCATION"))
    return found.where(F.length("surface") >= 3).distinct()


def term_places(texts: DataFrame, terms: DataFrame, key: str, term: str, keep_case: Column | bool = False) -> DataFrame:
    """The columns of terms, with key and text_, for every term that stands at word boundaries in text_ (lower-case), whatever its
    number of words. A text's words are equi-joined to the terms' rarest words; the candidates of a text are gathered and looked for in it
    where it is read again, so texts are joined but once, by their key. terms and what is sought are written, so that the join of words
    knows how small they are."""
    terms = saved(terms)
    term_id = F.struct(*[c for c in terms.columns])
    runs = terms.select(term, F.explode(word_runs(F.col(term))).alias("_word")).distinct()
    rarity = runs.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = runs.join(rarity, "_word").groupBy(term).agg(F.min(F.struct("_n", "_word"))["_word"].alias("_word"))
    keep = F.lit(keep_case) if isinstance(keep_case, bool) else keep_case
    sought = saved(terms.join(rarest, term).select("_word", term_id.alias("_of"), bounded(F.when(keep, F.col(term)).otherwise(F.lower(term))).alias("_term")))
    words = texts.select(key, F.explode(F.array_distinct(word_runs(F.col("text_")))).alias("_word"))
    candidates = words.join(sought, "_word").groupBy(key).agg(F.collect_set(F.struct("_of", "_term")).alias("_c"))
    met = texts.select(key, "text_").join(candidates.hint("merge"), key).withColumn("_marked", marked(F.col("text_")))
    hits = met.select(key, "text_", F.explode(F.filter("_c", lambda c: F.contains(F.col("_marked"), c["_term"]))).alias("_hit"))
    return hits.select(key, "text_", *[F.col(f"_hit._of.{c}").alias(c) for c in terms.columns])


def mentions(articles: DataFrame, names: DataFrame) -> DataFrame:
    """(article_id, canonical, type, text, start, end): first span of each entity named in title and body, the longest surface first; names
    that differ in case alone are one entity. text is the mention in small letters."""
    texts = articles.select("article_id", F.lower(F.trim(F.concat_ws(" ", "title", "body"))).alias("text_"))
    return first_spans(term_places(texts, names, "article_id", "surface").withColumn("at", place_of("surface")))


def place_of(term: str) -> Column:
    return F.expr(f"locate(lower({term}), text_) - 1")


def first_spans(found: DataFrame) -> DataFrame:
    """Mentions of found (article_id, surface, canonical, type, at)."""
    spans = found.select("article_id", "canonical", "type", F.lower("surface").alias("text"), F.col("at").alias("start"), (F.col("at") + F.length("surface")).alias("end"), F.length("surface").alias("_n"))
    rank = F.struct((-F.col("_n")).alias("n"), "start", "canonical", "end", "text")
    best = spans.groupBy("article_id", F.lower("canonical").alias("_key"), "type").agg(F.min(rank).alias("s"))
    return best.select("article_id", "s.canonical", "type", "s.text", "s.start", "s.end")


def part_links(texts: DataFrame, parts: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, mpn): the catalog's part numbers, in capitals as there, among the tokens of (key, text_) in any case. Letters of all
    scripts end no token. A null text has no tokens."""
    tokens = F.array_distinct(F.regexp_extract_all(F.upper("text_"), F.lit("(?U)" + L.PART_NUMBER), 0))
    return texts.select(key, F.explode(tokens).alias("mpn")).join(parts.select("mpn"), "mpn", "left_semi").select(key, "mpn")


def location_matches(locations: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """(location, key) where the location and the row's country are equal or one is part of the other. Every substring of a country
    or location is looked up by an equi-join, so no pair is tried that doesn't match."""
    l_text, c_text = F.lower(F.trim("location")), F.lower(F.trim("country"))
    cut = lambda name: F.expr(f"array_distinct(flatten(transform(sequence(1, length({name})), b -> transform(sequence(1, length({name}) - b + 1), n -> substring({name}, b, n)))))")
    places = locations.select("location", l_text.alias("_l")).where("_l <> ''").distinct()
    lands = dim.select("country", c_text.alias("_c")).where("_c <> ''").distinct()
    inside = places.join(lands.withColumn("_l", F.explode(cut("_c"))), "_l").select("location", "country")
    around = lands.join(places.withColumn("_c", F.explode(cut("_l"))), "_c").select("location", "country")
    return inside.unionByName(around).distinct().join(dim.select(key, "country"), "country").select("location", key).distinct()
