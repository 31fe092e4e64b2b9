"""Clusters, event identity, alerts, gates, impact forecasts, the store, and the reads over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import lexicon as L
from riskloom.functions.fuzzy import alike_pairs
from riskloom.functions.text import fingerprint, lookup, normalize_title, round_to, stable_id, strings, title_similarity, words
from riskloom.operators.linking import best_of, set_totals
from riskloom.operators.scoring import confidence, factors, review_reasons
from riskloom.operators.scoring import verification as mean_weights
from riskloom.plans.lineage import saved, spread

SIMILAR = 0.75


def similar_titles(titles: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, oa, b, ob, similarity) of distinct titles, a before b in order, at least that similar. titles: (title, ordinal).

    Word Jaccard j and content Jaccard c give 0.3 j + 0.7 c, so where both titles have content words c is at least (least - 0.3) / 0.7
    (0.643), and two titles share one of each one's n - ceil(0.643 n) + 1 rarest content words: only those are joined. Where a title
    has none, j itself is at least least, and the same holds of all its words. Equal titles but for case are joined as they are."""
    share = (least - 0.3) / 0.7
    w = titles.select("title", "ordinal", words(F.col("title")).alias("w")).withColumn("c", F.array_except("w", strings(L.STOP_WORDS)))
    each = w.select("title", "ordinal", F.size("w").alias("nw"), F.size("c").alias("nc"), F.explode("w").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("df"))
    content = ~F.col("word").isin(L.STOP_WORDS)
    ranked = each.join(rarity, "word").groupBy("title", "ordinal", "nw", "nc").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"), F.array_sort(F.array_compact(F.collect_list(F.when(content, F.struct("df", "word"))))).alias("rc"))
    first = lambda rows, n, s: F.slice(rows, F.lit(1), F.greatest(F.lit(0), n - F.ceil(n * s - 1e-9).cast("int") + 1))
    # kind c: among titles with content words; kind w: where one has none, so that all words count
    keys = F.concat(F.transform(first(F.col("rc"), F.col("nc"), share), lambda x: F.concat(F.lit("c "), x["word"])), F.when(F.col("nc") == 0, F.transform(F.col("r"), lambda x: F.concat(F.lit("w "), x["word"]))).otherwise(F.array().cast("array<string>")))
    keyed = ranked.select("title", "ordinal", "nw", "nc", F.explode(keys).alias("key"))
    # a title with content words meets those without any by its words
    meet = ranked.where("nc > 0 and nc < nw").select("title", "ordinal", "nw", "nc", F.explode(F.transform("r", lambda x: F.concat(F.lit("w "), x["word"]))).alias("key")).where(F.substring("key", 3, 99).isin(L.STOP_WORDS))
    left, right = (keyed.unionByName(meet).select(F.col("title").alias(n), F.col("ordinal").alias(f"o{n}"), F.col("nw").alias(f"w{n}"), F.col("nc").alias(f"c{n}"), "key") for n in "ab")
    alike = F.when((F.col("ca") > 0) & (F.col("cb") > 0), F.startswith("key", F.lit("c ")) & (F.least("ca", "cb") >= share * F.greatest("ca", "cb") - 1e-9)).otherwise(F.startswith("key", F.lit("w ")) & (F.least("wa", "wb") >= least * F.greatest("wa", "wb") - 1e-9))
    pairs = left.join(right, "key").where("oa < ob").where(alike).select("a", "oa", "b", "ob").distinct()
    pairs = saved(spread(pairs, "a", "b"))  # else the similarity is worked out below distinct, for each word that a pair shares
    return pairs.withColumn("similarity", title_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def clusters(articles: DataFrame) -> DataFrame:
    """(title, root): each distinct title, in order of appearance, joins the most similar earlier one (of several the first); a cluster is named by its first title. The chain is followed by doubling."""
    titles = saved(articles.groupBy("title").agg(F.min("article_id").alias("ordinal")))  # far fewer than the articles, which are read once
    pairs = similar_titles(titles)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("similarity", -F.col("oa"))).alias("parent"))
    link = titles.select("title").join(best.withColumnRenamed("b", "title"), "title", "left").select("title", F.coalesce("parent", "title").alias("root"))
    link = saved(link)
    while True:
        up = link.select(F.col("title").alias("root"), F.col("root").alias("next"))
        moved = link.join(up, "root").select("title", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        moved = saved(moved)
        link = moved.select("title", "root")
        if moved.where("moved").isEmpty():
            return link


def copies_of(rows: DataFrame) -> Column:
    """How many articles a row stands for."""
    return F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")


def cluster_modes(classified: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, n, mode): the clusters' sizes and most frequent categories, of several the one seen first. Counted by cluster and category
    before the clusters', so a hot cluster's articles are not gathered. A row stands for copies articles, where it has such a column."""
    by = classified.join(roots, "title").groupBy("root", "event_category").agg(F.sum(copies_of(classified)).alias("n"), F.min("article_id").alias("first"))
    return by.groupBy("root").agg(F.sum("n").alias("n"), F.max_by("event_category", F.struct("n", -F.col("first"))).alias("mode"))


def merged_links(articles: DataFrame, roots: DataFrame, article_sets: DataFrame, links: DataFrame) -> DataFrame:
    """(root, *link columns): the best link of each entity over a cluster's articles. Sets of links, which articles share, are told apart
    first, and entities before clusters, so a hot cluster's links are never gathered raw."""
    sets = articles.select("article_id", "title").join(roots, "title").join(article_sets, "article_id").select("root", "set_id").distinct()
    sets = spread(sets, "set_id")
    return best_of(sets.join(links, "set_id"), "root")


def merge_clusters(articles: DataFrame, roots: DataFrame, links: DataFrame, distributors: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One event per cluster of actionable, scored articles: the primary is the most severe, then most confident, then first article. Severity
    is that of the primary with the cluster's links (see merged_links), sources and verification; so is confidence. review_reasons are
    those of any article, without low classification confidence where two sources and more are verified. urls are sorted;
    they are those of the articles, or of (title, url). A row stands for copies articles, where it has such a column."""
    n = copies_of(articles)
    rows = articles.join(roots, "title").withColumn("_reasons", review_reasons(articles))
    n_providers, weight = mean_weights(F.col("provider"), F.col("tier"), n)
    told = F.sum(F.round(F.col("mention_confidence") * F.col("n_mentions") * 100).cast("long") * n)  # in hundredths, so that the order of a sum decides nothing
    of_primary = ["article_id", "title", "body", "provider", "event_category", "event_type", "class_confidence", "base_severity", "geo_score", "market_score", "geo_country", "metadata"]
    first = F.struct("severity", "class_confidence", -F.col("article_id"))
    g = rows.groupBy("root").agg(
        F.max_by(F.struct(*of_primary), first).alias("p"), F.sum(n).alias("source_count"), n_providers.alias("n_providers"), weight.alias("source_weight"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.sum(F.col("n_mentions") * n).alias("n_mentions"), told.alias("_told"),
    )
    reasons = rows.select("root", F.explode("_reasons").alias("r")).distinct().groupBy("root").agg(F.array_sort(F.collect_list("r")).alias("reasons"))
    linked = rows.select("root", "url") if urls is None else urls.join(roots, "title").select("root", "url")
    urls = linked.where("url <> ''").distinct().groupBy("root").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    totals = set_totals(links, distributors, "root")
    verified = round_to(F.least(F.lit(1.0), F.least(F.lit(1.0), 0.35 + 0.25 * F.col("n_providers")) * F.least(F.lit(1.0), F.col("source_weight"))), 3)
    df = g.join(totals, "root", "left").join(reasons, "root", "left").join(urls, "root", "left").select("*", *[F.col(f"p.{c}").alias("primary_id" if c == "article_id" else c) for c in of_primary]).drop("p")
    none = F.array().cast("array<string>")
    df = df.withColumns({"verification": verified, "n_links": F.coalesce("n_links", F.lit(0)), "link_score": F.coalesce("link_score", F.lit(0.0)), "mention_confidence": F.when(F.col("n_mentions") > 0, F.col("_told") / (F.col("n_mentions") * 100.0)).otherwise(0.0), "n_sources": F.col("source_count"), "urls": F.coalesce("urls", none), "reasons": F.coalesce("reasons", none)}).drop("_told")
    sure = (F.col("source_count") >= 2) & (F.col("verification") >= 0.6)
    df = confidence(factors(df, F.col("source_count"), F.col("verification")))
    return df.withColumn("review_reasons", F.when(sure, F.array_remove("reasons", "low_classification_confidence")).otherwise(F.col("reasons"))).drop("reasons")


def nested_links(links: DataFrame, key: str = "root") -> DataFrame:
    """(key, suppliers, manufacturers, components, locations): each entity type's links as an array of structs in the order of their ids."""
    of = F.struct("canonical", "name", F.round("score", 6).alias("score"), "method", "text", "review")
    kinds = {"suppliers": "SUPPLIER", "manufacturers": "MANUFACTURER", "components": "COMPONENT", "locations": "LOCATION"}
    return links.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == v, of))).alias(k) for k, v in kinds.items()])


def with_identity(df: DataFrame, title: str, category: str, geo: str) -> DataFrame:
    print_ = fingerprint(F.col(title), F.col(category), F.col(geo))
    return df.withColumn("fingerprint", print_).withColumn("stable_id", stable_id(F.col("fingerprint")))


def resolve_identity(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """batch rows with the event they belong to: an existing row of equal fingerprint (the first), else the batch's first row of it. status is updated where an earlier row exists."""
    known = existing.groupBy("fingerprint").agg(F.min("event_id").alias("known_id"))
    w = Window.partitionBy("fingerprint").orderBy("event_id")
    first = F.first("event_id").over(w)
    return batch.join(known, "fingerprint", "left").select("event_id", "fingerprint", F.coalesce("known_id", first).alias("resolved_id"), F.when(F.col("known_id").isNotNull() | (F.row_number().over(w) > 1), "updated").otherwise("detected").alias("new_status"))


def resolve_identity_fuzzily(batch: DataFrame, existing: DataFrame, least: float = 88.0) -> DataFrame:
    """As resolve_identity, and where no existing row has the fingerprint, a row joins the first row before it (existing ones first,
    then the batch in order of event_id) of its category whose normalised title has an Indel ratio of at least that. A row that
    joins one of the batch has that one's event. Needs title and event_category; empty titles match by fingerprint alone."""
    known = existing.groupBy("fingerprint").agg(F.min("event_id").alias("known_id"))
    titled = lambda df: df.select("event_id", "fingerprint", F.coalesce("event_category", F.lit("")).alias("block"), normalize_title(F.col("title")).alias("text"))
    rows, old = saved(titled(batch).join(known, "fingerprint", "left")), titled(existing)
    first = lambda df, name: df.where("text <> ''").groupBy("block", "text").agg(F.min("event_id").alias(name))
    groups = first(old, "e").join(first(rows, "f"), ["block", "text"], "full")
    near = alike_pairs(groups, least).join(groups.withColumnRenamed("text", "b"), ["block", "b"]).groupBy("block", F.col("a").alias("text")).agg(F.min("e").alias("e"), F.min("f").alias("f"))
    same = Window.partitionBy("fingerprint")
    found = rows.join(near, ["block", "text"], "left").withColumn("f", F.coalesce("f", F.min("event_id").over(same)))
    to = F.coalesce("known_id", "e")
    link = saved(found.select("event_id", "fingerprint", to.isNotNull().alias("done"), F.coalesce(to, F.least("f", "event_id")).alias("at"), (to.isNotNull() | (F.col("f") < F.col("event_id"))).alias("updated")))
    while True:
        up = link.select(F.col("event_id").alias("at"), F.col("at").alias("next"), F.col("done").alias("next_done"))
        follow = ~F.col("done") & F.col("next").isNotNull()
        moved = saved(link.join(up, "at", "left").select("event_id", "fingerprint", F.when(follow, F.col("next_done")).otherwise(F.col("done")).alias("done"), F.when(follow, F.col("next")).otherwise(F.col("at")).alias("at"), "updated", (follow & ((F.col("next") != F.col("at")) | F.col("next_done"))).alias("moved")))
        link = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return link.select("event_id", "fingerprint", F.col("at").alias("resolved_id"), F.when(F.col("updated"), "updated").otherwise("detected").alias("new_status"))


def keepers(rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Each group's row of largest severity, then latest, then least id, and the number of the others."""
    best = F.struct("severity", "retrieved_at", (-F.col("event_id")).alias("e"))
    return rows.groupBy(key).agg(F.max(best).alias("b"), F.count("*").alias("n")).select(key, (-F.col("b.e")).alias("keep_id"), F.col("b.severity").alias("severity"), (F.col("n") - 1).alias("n_duplicates"))


def reparent(children: DataFrame, rows: DataFrame, keep: DataFrame) -> DataFrame:
    """children with event_id replaced by its group's keeper."""
    to = rows.select("event_id", "fingerprint").join(keep.select("fingerprint", "keep_id"), "fingerprint").select("event_id", "keep_id")
    return children.join(to, "event_id").select("child_id", F.col("keep_id").alias("event_id"))


def upsert(old: DataFrame, new: DataFrame, key: str = "event_id", update: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key, in the columns of update only where it is given; the rest of both stay. Of several
    new rows of a key the greatest counts."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("n")).select(key, *[F.col(f"n.{c}").alias(c) for c in rest])
    both = old.withColumn("_old", F.lit(True)).alias("o").join(one.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    keep = set(rest) if update is None else set(update)
    choose = lambda c: F.when(F.col("_new") & (F.lit(c in keep) | F.col("_old").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(key, *[choose(c).alias(c) for c in rest])


def upsert_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Analyses or predictions by event: as upsert, but a new row without a result or marked as skipped changes nothing."""
    return upsert(old, new.where("result is not null and not coalesce(skipped, false)").drop("skipped"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old, and of the new ones those whose keys it lacks; of several new rows of a key the least is added (rows have no
    order). A null in a key equals no key of old, and one row is added for it."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("n")).select(*keys, *[F.col(f"n.{c}").alias(c) for c in rest])
    return old.select(*keys, *rest).unionByName(one.join(old.select(*keys), keys, "left_anti"))


def status_history(batch: DataFrame) -> DataFrame:
    """What a stored batch appends to the history of its events."""
    return batch.select("event_id", "status", "run_id", F.when(F.col("status") == "updated", "updated").otherwise("persisted").alias("action"))


def alert_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.ALERTS, "rule_id string, rule_name string, min_severity double, min_sources int, min_verification double, category string")


def alert_matches(events: DataFrame) -> DataFrame:
    """One row per event and rule that matches it. The rules are a short fixed list, so each event carries those it meets."""
    met = []
    for rule_id, name, sev, sources, verified, category in L.ALERTS:
        test = F.lit(True)
        for column, least in (("severity", sev), ("source_count", sources), ("verification", verified)):
            test = test if least is None else test & (F.col(column) >= least)
        test = test if category is None else test & (F.col("event_category") == category)
        met.append(F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"))))
    return events.select("event_id", "severity", F.explode(F.array_compact(F.array(*met))).alias("r")).select("event_id", "severity", "r.*")


def analysis_gate(min_severity: float = 50.0, min_confidence: float = 0.5) -> Column:
    """The first reason not to analyse an event, else eligible."""
    return F.when(F.coalesce("severity", F.lit(0.0)) < min_severity, "severity_below_threshold").when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "confidence_below_threshold").otherwise("eligible")


def analysis_budget(events: DataFrame, priority: float = 65.0, max_events: int = 10) -> DataFrame:
    """Eligible events: all of priority severity, and of the rest the max_events most severe (0: all)."""
    eligible = events.where(analysis_gate() == "eligible")
    if max_events <= 0:
        return eligible.select("event_id", "severity", F.lit(True).alias("selected"))
    top = eligible.where(F.col("severity") < priority).orderBy(F.desc("severity"), "event_id").limit(max_events).select("event_id", F.lit(True).alias("in_budget"))
    return eligible.join(top, "event_id", "left").select("event_id", "severity", ((F.col("severity") >= priority) | F.coalesce("in_budget", F.lit(False))).alias("selected"))


def impact(events: DataFrame, lead_times: DataFrame) -> DataFrame:
    """Rule-based forecast: category priors by severity, components, sources and the suppliers' mean lead time (supplier_code, avg_lead)."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), round_to(round_to(c, 9), 3)))
    df = events.join(lead_times, "supplier_code", "left")
    mult = 0.55 + F.col("severity") / 100.0 * 0.55
    prior = lambda k: lookup(F.col("event_category"), {c: v[k] for c, v in L.BASELINES.items()}, L.DEFAULT_BASELINE[k])
    delay, making, moving, stock, price = (clamp(prior(k) * mult) for k in range(5))
    stock = F.when(F.col("n_components") >= 3, clamp(stock + 0.08)).otherwise(stock)
    moving = F.when(F.col("source_count") >= 2, clamp(moving + F.least(F.lit(0.05), 0.02 * (F.col("source_count") - 1)))).otherwise(moving)
    lead = F.coalesce("avg_lead", F.lit(float(L.DEFAULT_LEAD_TIME))).cast("int")
    low = F.greatest(prior(5), (lead * 0.5).cast("int"))
    high = F.greatest(prior(6), lead, low)
    evidence = 5 + 1 + F.when(F.col("avg_lead").isNotNull(), 1).otherwise(0)
    conf = clamp(0.35 + F.col("confidence") * 0.35 + F.col("verification") * 0.15 + F.least(F.lit(0.15), evidence * 0.02))
    return df.where("severity >= 35").select(
        "event_id", delay.alias("supply_delay"), making.alias("manufacturing"), moving.alias("logistics"), stock.alias("inventory"), price.alias("price"),
        low.cast("int").alias("recovery_min"), F.when(mult >= 0.95, (high * 1.25).cast("int")).otherwise(high).cast("int").alias("recovery_max"), conf.alias("prediction_confidence"),
    )


def bounded_adjustment(rule: Column, target: Column, most: float = 0.15) -> Column:
    """target, at most that far from the rule's value."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), round_to(F.greatest(rule - most, F.least(rule + most, target)), 3)))


def lead_times(stock: DataFrame) -> DataFrame:
    return stock.groupBy(F.col("code").alias("supplier_code")).agg(round_to(F.sum(F.col("lead_time_days").cast("long")) / F.count("lead_time_days"), 1).alias("avg_lead"))


def list_events(events: DataFrame, category: str | None = None, min_severity: float | None = None, status: str | None = None, search: str | None = None, run_id: str | None = None) -> DataFrame:
    """Filters that are given; a search may span title, summary, country and type."""
    for column, value in (("event_category", category), ("status", status), ("run_id", run_id)):
        events = events.where(F.col(column) == value) if value else events
    if min_severity is not None:
        if not 0 <= min_severity <= 100:
            raise ValueError("0 <= min_severity <= 100")
        events = events.where(F.coalesce("severity", F.lit(0.0)) >= min_severity)
    if search:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "geo_country", "event_type")]))
        events = events.where(F.contains(hay, F.lit(search.lower())))
    return events


#: Columns of a list of events, beside the flags.
LISTED = ["event_id", "title", "summary", "event_type", "event_category", "severity", "class_confidence", "confidence", "verification", "source_count", "status", "run_id", "supplier_code", "geo_country", "latitude", "longitude", "retrieved_at"]


def with_flags(events: DataFrame, analyses: DataFrame, predictions: DataFrame) -> DataFrame:
    """events with has_analysis and has_prediction: whether the results (event_id) have any of theirs."""
    for name, results in (("has_analysis", analyses), ("has_prediction", predictions)):
        events = events.join(results.select("event_id", F.lit(True).alias(name)).distinct(), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return events


def page(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("1 <= limit <= 200 and offset >= 0")
    return events.orderBy(F.desc("severity"), "event_id").offset(offset).limit(limit)


def detail(event_id: int, events: DataFrame, analyses: DataFrame, predictions: DataFrame, articles: DataFrame, alerts: DataFrame) -> DataFrame:
    """The event with its analysis (result) and prediction, null where there is none, and arrays of its articles (article_id, provider) and of
    the rules that it met (rule_id), both in order. The id is looked for in each table before anything is joined."""
    of = lambda df: df.where(F.col("event_id") == event_id)
    read = of(articles).groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("article_id", "provider"))).alias("articles"))
    met = of(alerts).groupBy("event_id").agg(F.array_sort(F.collect_set("rule_id")).alias("alerts"))
    found = of(events).join(of(analyses).groupBy("event_id").agg(F.max("result").alias("analysis")), "event_id", "left").join(of(predictions), "event_id", "left").join(read, "event_id", "left").join(met, "event_id", "left")
    return found.withColumns({"articles": F.coalesce("articles", F.array().cast("array<struct<article_id: string, provider: string>>")), "alerts": F.coalesce("alerts", F.array().cast("array<string>"))})


def runs(events: DataFrame) -> DataFrame:
    """Each run's events and largest severity, the last run first."""
    return events.groupBy(F.coalesce("run_id", F.lit("unknown")).alias("run_id")).agg(F.count("*").alias("n_events"), F.max("severity").alias("max_severity")).orderBy(F.desc("run_id"))


def summary(events: DataFrame) -> DataFrame:
    """Counts by category, by status and overall, in one pass; how many have an analysis and a prediction (see with_flags)."""
    g = events.groupingSets([(), ("event_category",), ("status",)], "event_category", "status")
    rows = g.agg(F.count("*").alias("n"), round_to(F.avg("severity"), 1).alias("avg_severity"), F.max("severity").alias("max_severity"), F.count_if("has_analysis").alias("with_analysis"), F.count_if("has_prediction").alias("with_prediction"), F.grouping_id().alias("_g"))
    return rows.select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "category").otherwise("status").alias("kind"), F.coalesce("event_category", "status", F.lit("")).alias("value"), "n", "avg_severity", "max_severity", "with_analysis", "with_prediction")


def geo_points(events: DataFrame, min_severity: float = 0.0) -> DataFrame:
    return events.where((F.col("severity") >= min_severity) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("event_id", "title", "event_category", "severity", "latitude", "longitude", "geo_country")


def alert_feed(events: DataFrame) -> DataFrame:
    return page(events.where("severity >= 60"), 200).select("event_id", "title", "event_category", "severity", "status", "run_id")


SNAPSHOT = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("pipeline_version", T.StringType()), T.StructField("risk_events", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("title", T.StringType()), ("severity_score", T.DoubleType()), ("run_id", T.StringType()))])))])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON snapshot; a file that is empty or no object has none, and a missing run_id is the header's."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select("run_id", F.explode("risk_events").alias("e")).select(F.col("e.event_id"), F.col("e.title"), F.col("e.severity_score"), F.coalesce("e.run_id", "run_id").alias("run_id"))
