"""Relevance, classification, severity and confidence of articles, as column expressions and equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import lexicon as L
from riskloom.functions.metadata import market_metric, parsed, unparsed
from riskloom.functions.text import any_of, best_of, count_of, lookup, quoted, round_to, strings
from riskloom.operators.catalog import term_places


def article_text(df: DataFrame) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", df["title"], df["body"])))


def _lexicon() -> Column:
    """Topic keywords, the longest first."""
    rows = [(topic, word, weight * (0.25 if topic in L.CORE_TOPICS else 0.20), 0.12 * weight) for topic, (weight, words) in L.TOPICS.items() for word in words]
    rows.sort(key=lambda r: -len(r[1]))
    return F.expr("array(" + ", ".join(f"named_struct('topic', {quoted(t)}, 'word', {quoted(w)}, 'score', {s!r}D, 'meta', {m!r}D)" for t, w, s, m in rows) + ")")


def term_hits(hits: DataFrame, kind: str, key: str = "article_id") -> DataFrame:
    """(key, n, found): how many terms of the kind each text holds, and which, the longest first."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term")))
    return hits.where(F.col("kind") == kind).groupBy(key).agg(F.count("*").alias("n"), F.transform(order, lambda t: t["term"]).alias("found"))


def entity_terms(manufacturers: DataFrame) -> DataFrame:
    """Names and aliases of three characters and more."""
    return manufacturers.select(F.explode(F.array("name", "alias")).alias("term")).where(F.length("term") >= 3)


def relevance_terms(manufacturers: DataFrame, categories: DataFrame) -> DataFrame:
    """(term, kind): names of manufacturers (m), and categories (c), which keep their capitals."""
    both = entity_terms(manufacturers).withColumn("kind", F.lit("m")).unionByName(categories.select("term").withColumn("kind", F.lit("c")))
    return both.where("term <> ''").distinct()


def relevance(articles: DataFrame, manufacturers: DataFrame, categories: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """articles with score (rounded), exact (not rounded to four digits), matched (terms, joined), reason and least (exact score needed).
    categories: (term). hits: (article_id, term, kind) of relevance_terms, if they were looked for already. A category keeps its capitals while the text loses them, so one with capitals never matches. The code of an
    event counts where it stands at the top of the metadata, not inside its raw record."""
    if hits is None:
        texts = articles.select("article_id", article_text(articles).alias("text_"))
        hits = term_places(texts, relevance_terms(manufacturers, categories), "article_id", "term", F.col("kind") == "c")
    named = lambda kind, n, found: term_hits(hits, kind).select("article_id", F.col("n").alias(n), F.col("found").alias(found))
    df = articles.join(named("m", "_mfr", "_mfr_found").hint("merge"), "article_id", "left").join(named("c", "_cat", "_cat_found").hint("merge"), "article_id", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"_text": article_text(articles), "_n_mfr": F.coalesce("_mfr", F.lit(0)), "_n_cat": F.coalesce("_cat", F.lit(0)), "_mfr_found": F.coalesce("_mfr_found", none), "_cat_found": F.coalesce("_cat_found", none)})
    text, n_mfr, n_cat = F.col("_text"), F.col("_n_mfr"), F.col("_n_cat")
    df = df.withColumn("_hits", F.filter(_lexicon(), lambda k: F.contains(text, k["word"])))
    hits_ = F.col("_hits")
    meta, gdelt = F.lower("metadata"), F.col("provider") == "gdelt"
    df = df.withColumn("_meta", F.when(gdelt & meta.isNotNull(), F.filter(_lexicon(), lambda k: F.contains(meta, k["word"]) & ~F.contains(text, k["word"]))).otherwise(F.slice(hits_, 1, 0)))
    code = F.upper(F.get_json_object("metadata", "$.event_code"))
    df = df.withColumn("_code", F.when(gdelt & code.isin(L.SIGNAL_CODES), code)).withColumn("_context", count_of(text, L.CONTEXT) >= 2)
    sum_of = lambda rows, field: F.aggregate(rows, F.lit(0.0), lambda a, k: a + k[field])
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    context, several, both = F.col("_context"), F.size(hits_) >= 2, (n_mfr > 0) & (n_cat > 0)
    strong = (n_mfr + n_cat >= 2) | ((n_mfr > 0) & context)
    with_topic = (n_mfr > 0) & (F.size(hits_) > 0)
    score = sum_of(hits_, "score") + 0.35 * n_mfr + 0.20 * n_cat + add(several, 0.15) + add(both, 0.20) + add(with_topic, 0.10) + sum_of(F.col("_meta"), "meta") + add(F.col("_code").isNotNull(), 0.15) + add(strong, 0.10)
    matched = (F.size(hits_) > 0) | (n_mfr + n_cat > 0) | (F.size("_meta") > 0) | F.col("_code").isNotNull()
    negative = F.element_at(F.filter(strings(L.NEGATIVE), lambda w: F.contains(text, w)), 1)
    of = lambda head, rows: F.transform(rows, lambda t: F.concat(F.lit(head), t))
    signal = lambda test, name: F.when(test, F.lit("signal:" + name))
    names = F.array_join(F.concat(
        F.transform(hits_, lambda k: F.concat_ws(":", k["topic"], k["word"])), of("manufacturer:", F.col("_mfr_found")), of("category:", F.col("_cat_found")),
        F.array_compact(F.array(signal(several, "multi_topic_cooccurrence"), signal(both, "manufacturer_category_cooccurrence"), signal(with_topic, "manufacturer_topic_cooccurrence"))),
        F.transform(F.col("_meta"), lambda k: F.concat_ws(":", F.lit("metadata"), k["topic"], k["word"])), F.array_compact(F.array(F.concat(F.lit("metadata:gdelt_event_code:"), "_code"), signal(strong, "strong_context"))),
    ), ",")
    auto = F.col("provider") == L.AUTO_PASS
    df = df.withColumn("_raw", score).withColumn("_neg", F.when(F.size(F.filter(strings(L.NEGATIVE), lambda w: F.contains(text, w))) > 0, negative))
    exact = round_to(F.when(auto, 1.0).when(text == "", 0.0).when(F.col("_neg").isNotNull(), 0.0).when(~matched, F.when(context, 0.15).otherwise(0.12)).otherwise(F.least(F.lit(1.0), F.col("_raw"))), 9)
    return df.select(
        *articles.columns, exact.alias("exact"),
        F.when(auto, "provider:auto_pass").when(text == "", "").when(F.col("_neg").isNotNull(), F.concat(F.lit("negative:"), "_neg")).otherwise(names).alias("matched"),
        F.array_join("_mfr_found", ",").alias("manufacturers_found"),
        F.when(auto, "provider_auto_pass").when(text == "", "empty_content").when(F.col("_neg").isNotNull(), "negative_keyword_match").when(~matched, F.when(context, "has_context_no_direct_match").otherwise("no_keyword_or_entity_match")).otherwise("keyword_entity_score").alias("reason"),
        lookup(F.col("provider"), {p: v[2] for p, v in L.PROVIDERS.items()}, 0.40).alias("least"),
    ).withColumn("score", round_to(F.col("exact"), 4))


def kept(scored: DataFrame) -> DataFrame:
    """The rows that pass the gate. scored is best a written table: a filter is else pushed below the score, which is then computed twice."""
    return scored.where(F.col("exact") >= F.col("least"))


def dropped(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("exact") < F.col("least"))


def classify(df: DataFrame) -> DataFrame:
    """df (articles with n_links and n_mentions) with text_lower, event_category, event_type and class_confidence."""
    df = df.withColumn("text_lower", article_text(df))
    text, linked = F.col("text_lower"), F.col("n_links")
    best = F.struct(F.lit(0.0).alias("conf"), F.lit(-99).alias("rank"), F.lit("").alias("category"), F.lit("").alias("type"))
    options = [best]
    for rank, (category, kind, words, conf) in enumerate(L.RULES):
        n = count_of(text, words)
        options.append(F.when(n >= 1, F.struct(F.when(n >= 2, min(conf + 0.05, 1.0)).otherwise(conf).alias("conf"), F.lit(-rank).alias("rank"), F.lit(category).alias("category"), F.lit(kind).alias("type"))))
    mood = F.when(linked > 0, 0.80).otherwise(0.72)
    options.append(F.when((F.col("provider") == "marketaux") & (F.col("sentiment") <= -0.2), F.struct(mood.alias("conf"), F.lit(-50).alias("rank"), F.lit("financial_distress").alias("category"), F.lit("credit_downgrade").alias("type"))))
    entity = F.least(F.lit(0.15), F.when(linked >= 6, 0.15).when(linked >= 3, 0.10).when(linked >= 1, 0.05).otherwise(0.0) + F.when(F.col("n_mentions") >= 3, 0.05).otherwise(0.0))
    both = linked + F.col("n_mentions")
    df = df.withColumn("_best", F.array_max(F.filter(F.array(*options), lambda o: o.isNotNull()))).withColumn("_code", F.when(F.col("provider") == "gdacs", F.upper("gdacs_type")))
    matched, b = F.col("_best.conf") > 0, F.col("_best")
    fallback = F.when((F.col("score") >= 0.5) | (both >= 2), F.when(both >= 3, 0.55).when(both >= 1, 0.50).otherwise(0.45)).otherwise(0.25)

    def choose(k: int, rule: Column, other: Column) -> Column:
        found = F.when(matched, rule).otherwise(other)
        for code, value in L.GDACS.items():
            found = F.when(F.col("_code") == code, F.lit(value[k])).otherwise(found)
        return found

    return df.withColumns({
        "event_category": choose(0, b["category"], F.lit("other")), "event_type": choose(1, b["type"], F.lit("unclassified")),
        "class_confidence": round_to(choose(2, F.least(F.lit(1.0), b["conf"] + entity), fallback), 6),
    }).drop("_best", "_code")


def actionable(df: DataFrame) -> Column:
    """Whether a classified article tells of a disruption; the first condition that holds decides."""
    named = F.col("event_category") != "other"
    quiet = F.upper("category").isin(L.QUIET_CATEGORIES) | F.startswith(F.upper("event_code"), F.lit("CO"))
    calm = F.contains(F.upper("subcategory"), F.lit("MILESTONE")) | F.contains(F.upper("subcategory"), F.lit("DEVELOPMENT"))
    return (
        F.when(any_of(F.col("text_lower"), L.SIGNALS), True).when(named & (F.col("class_confidence") >= 0.6), True).when(F.col("provider") == "gdacs", True)
        .when(F.coalesce(quiet, F.lit(False)), False).when(F.coalesce(calm, F.lit(False)), False).when((F.col("significance") < 0.4) & ~named, False)
        .when(F.col("severity") >= 55, True).when((F.col("n_links") > 0) & named, True).otherwise(False)
    )


def base_severity(df: DataFrame) -> DataFrame:
    """df with base_severity. Every boost is capped at 100, which is the cap of their sum; what is used twice is a column of its own."""
    text, n, category = F.col("text_lower"), F.col("n_links"), F.col("event_category")
    cap = lambda c: F.least(F.lit(100.0), c)
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    df = df.withColumns({"_place": best_of(text, L.LOCATIONS), "_force": best_of(text, L.INTENSITY), "_level": lookup(F.lower(F.coalesce("alert_level", F.lit(""))), L.ALERT_LEVELS, 30.0), "_size": F.regexp_extract(text, r"magnitude\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")})
    place, force = F.col("_place"), F.col("_force")
    gdacs = F.greatest("_level", F.coalesce(cap(F.col("magnitude") * 12), "_level"))
    money = cap(F.when(F.col("sentiment").isNotNull(), cap(40.0 + F.abs("sentiment") * 60.0)).when(any_of(text, ["bankruptcy", "default", "crisis"]), 75.0).otherwise(30.0) + add(n >= 2, 10.0))
    nature = cap(F.coalesce(cap(F.col("_size") * 12), F.lit(30.0)) + place * 15)
    work = cap(55.0 + force * 30 + F.when(category == "logistics_disruption", place * 20).otherwise(0.0) + F.when(n >= 5, 15.0).when(n >= 2, 8.0).otherwise(0.0) + add(any_of(text, L.URGENT), 5.0))
    trade = cap(60.0 + add(any_of(text, ["ban", "embargo", "restrict", "comprehensive"]), 12.0) + add(any_of(text, ["comprehensive", "all", "entire", "full"]), 10.0) + add(n >= 3, 10.0))
    base = F.when(F.col("provider") == "gdacs", gdacs).when(category == "financial_distress", money).when(category == "natural_disaster", nature).when(category.isin("factory_shutdown", "logistics_disruption", "labor_action"), work).when(category == "export_sanction", trade).otherwise(30.0)
    return df.withColumn("base_severity", round_to(base, 1)).drop("_force", "_level", "_size")


def severity(df: DataFrame) -> DataFrame:
    """df with base_severity, the seven factors' contributions, severity and what it is driven by. supplier_risk is the largest risk of the
    linked suppliers; a market metric in the metadata goes before the category's sensitivity."""
    df = base_severity(df)
    place = F.greatest("_place", F.when(F.col("geo_country").isNotNull(), 0.55).otherwise(0.0))
    market = F.coalesce(market_metric() * 100.0, lookup(F.col("event_category"), L.MARKET, 35.0))
    return factors(unparsed(parsed(df).withColumns({"geo_score": place * 100.0, "market_score": market})).drop("_place"))


def factors(df: DataFrame, source_count: Column | None = None, verification: Column | None = None) -> DataFrame:
    """df (base_severity, supplier_risk, provider, n_links, geo_score, market_score) with c_ of each factor, severity, top_factors and
    severity_summary. A cluster has its number of sources and their verification."""
    n, count, verified = F.col("n_links"), F.lit(1) if source_count is None else source_count, F.lit(0.0) if verification is None else verification
    several = F.when(count <= 1, verified * 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50.0 + verified * 50.0 + (count - 1) * 10.0)))
    parts = {
        "base_rule_score": F.col("base_severity"), "supplier_criticality": F.coalesce("supplier_risk", F.lit(0.0)) * 100.0, "source_reliability": lookup(F.col("provider"), {p: v[1] for p, v in L.PROVIDERS.items()}, 0.5) * 100.0,
        "entity_impact": F.when(n == 0, 10.0).when(n >= 6, 90.0).when(n >= 3, 65.0).otherwise(40.0), "geographic_importance": F.col("geo_score"), "market_sensitivity": F.col("market_score"), "multi_source_confirmation": several,
    }
    df = df.withColumns({f"c_{k}": round_to(v * L.WEIGHTS[k], 2) for k, v in parts.items()})
    total = sum((F.col(f"c_{k}") for k in parts), F.lit(0.0))
    order = F.array(*[F.struct((-F.col(f"c_{k}")).alias("c"), F.lit(i).alias("i"), F.lit(k).alias("factor")) for i, k in enumerate(parts)])
    first = F.slice(F.array_sort(order), 1, 3)
    names, told = F.transform(first, lambda s: s["factor"]), F.transform(first, lambda s: F.concat(s["factor"], F.lit(" ("), F.call_function("format_number", -s["c"], F.lit("0.0")), F.lit(")")))
    df = df.withColumn("severity", round_to(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1))
    return df.withColumn("top_factors", F.array_join(names, ",")).withColumn("severity_summary", F.concat(F.lit("Severity "), F.col("severity").cast("string"), F.lit("/100 driven by: "), F.array_join(told, ", ")))


def confidence(df: DataFrame) -> DataFrame:
    """df with overall_confidence and uncertainties. Needs link_score, mention_confidence, source_weight, n_sources and verification."""
    overall = round_to(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("class_confidence") * 0.35 + F.col("link_score") * 0.25 + F.col("mention_confidence") * 0.15 + F.col("source_weight") * 0.15 + F.col("verification") * 0.10)), 3)
    doubts = F.array_compact(F.array(
        F.when(F.col("n_sources") < 2, "few_sources"), F.when(F.col("class_confidence") < 0.6, "low_classification_confidence"), F.when((F.col("n_mentions") > 0) & (F.col("link_score") < 0.7), "weak_entity_matching"),
        F.when((F.col("n_links") == 0) & ~F.col("event_category").isin("natural_disaster", "other"), "missing_entity_links"), F.when((F.col("verification") < 0.5) & (F.col("n_sources") >= 2), "weak_multi_source_agreement"),
    ))
    return df.withColumn("overall_confidence", overall).withColumn("uncertainties", F.array_join(doubts, ","))


def review_reasons(df: DataFrame, class_threshold: float = 0.6, link_threshold: float = 0.7) -> Column:
    named = ~F.col("event_category").isin("natural_disaster", "other")
    return F.array_compact(F.array(
        F.when(F.col("class_confidence") < class_threshold, "low_classification_confidence"), F.when((F.col("link_score") < link_threshold) & (F.col("n_mentions") > 0), "low_entity_link_confidence"), F.when((F.col("n_mentions") == 0) & named, "no_entities_for_event_type"),
        F.when((F.col("severity") >= 70) & (F.col("class_confidence") < 0.70), "high_severity_low_confidence_mismatch"), F.when(F.col("event_category").isin("factory_shutdown", "logistics_disruption", "export_sanction") & (F.col("n_links") < 1), "supply_chain_event_no_entities"),
    ))


def verification(providers: Column, tiers: Column, copies: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: (distinct providers, mean tier weight), rows counted by copies. Weights are added in hundredths, so that the order of a sum decides nothing."""
    n = F.lit(1).cast("long") if copies is None else copies
    return F.count_distinct(providers), F.sum(lookup(tiers, {1: 100, 2: 85, 3: 65}, 50) * n) / (F.sum(n) * 100.0)
