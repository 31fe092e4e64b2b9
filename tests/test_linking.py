"""Metadata, fuzzy joins, links, sections and merging of clusters on small hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import fuzzy
from riskloom.functions import metadata as M
from riskloom.operators import analysis as A
from riskloom.operators import catalog as C
from riskloom.operators import events as E
from riskloom.operators import linking as N
from riskloom.operators import sections as Q
from riskloom.operators import store as W
from riskloom.plans.lineage import counted


def places(spark, *metadata):
    frame = spark.createDataFrame([(k, m if m is None or isinstance(m, str) else json.dumps(m)) for k, m in enumerate(metadata)], "article_id long, metadata string")
    found = {k: [] for k in range(len(metadata))}
    for r in N.metadata_places(frame).orderBy("article_id", "ordinal").collect():
        found[r.article_id].append((r.label, r.source))
    return [found[k] for k in range(len(metadata))]


def test_places_of_metadata(spark):
    got = places(
        spark, {"raw": {"geo": {"country": "Oman", "region": "Middle East", "location": "Muscat"}}}, {"raw": {"geo": {"country": "Iran"}, "country": "iran"}, "country": "IRAN"}, {"geo": {"country": ["oman", "Oman", ["peru", "chad"]], "admin1": "x"}},
        {"country": "['tajikistan', \"west  coast\"]"}, {"geo": "text", "country": 7.5, "affected_countries": [{"countryname": "", "country": "Chile"}, {"countryname": "Laos"}, "laos", 42, None, {"a": 1}]}, {"affected_countries": "none", "geo": {"country": {"name": "x"}}}, None, "[1]", "broken {", {}, {"raw": 3, "country": "東芝国"},
    )
    assert got == [
        [("Oman", "geo.country"), ("Muscat", "geo.location")], [("Iran", "geo.country")], [("Oman", "geo.country"), ("Peru", "geo.country"), ("Chad", "geo.country")], [("Tajikistan", "raw.country"), ("West Coast", "raw.country")],
        [("7.5", "raw.country"), ("Chile", "affected_countries"), ("Laos", "affected_countries"), ("42", "affected_countries")], [], [], [], [], [], [("東芝国", "raw.country")],
    ]


def test_coordinates_and_metrics(spark):
    rows = [{"geo": {"latitude": "12.5", "longitude": 7, "country": "oman", "region": "middle east"}}, {"geo": {"latitude": "x", "longitude": None, "country": ""}, "country": ["peru", "Chile"]}, {"raw": {"geo": []}, "country": 3}, {"metrics": {"market_sensitivity": "high", "systemic_importance": " 0.4 "}}, {"raw": {"metrics": {"market_sensitivity": {}, "propagation_potential": True}}}, {"metrics": [1]}]
    frame = M.parsed(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k int, metadata string"))
    lat, lon, country, region = M.coordinates()
    got = [tuple(r) for r in frame.orderBy("k").select(lat.alias("a"), lon.alias("b"), country.alias("c"), region.alias("d"), M.market_metric().alias("m")).collect()]
    assert got == [(12.5, 7.0, "Oman", "Middle East", None), (None, None, "Peru, Chile", None, None), (None, None, "3", None, None), (None, None, None, None, 0.4), (None, None, None, None, 1.0), (None, None, None, None, None)]


@pytest.mark.parametrize("least", [60.0, 75.0, 90.0])
def test_partial_pairs_lose_none(spark, least):
    rnd = random.Random(int(least))
    word = lambda: "".join(rnd.choice("aabcde #1") for _ in range(rnd.randint(1, 14)))
    left, right = sorted({word() for _ in range(90)}), sorted({word() for _ in range(60)} | {"texas instruments", "ti", "nxp"})
    left += ["texas instrument", "texas", "xnp", "東芝"]
    right += ["東芝電子"]
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "text string")
    got = {(r.a, r.b): round(r.score, 9) for r in fuzzy.partial_pairs(frame(left), frame(right), least).collect()}
    want = {(a, b): round(s, 9) for a in left for b in right if (s := fuzzy.partial_ratio(a, b)) >= least}
    assert got == want and len(want) > 20


def test_fuzzy_manufacturers_rank_five_and_the_first_wins(spark):
    names = ["Acme A", "Acme B", "Acme C", "Acme D", "Acme E", "Acme F", "Zeta"]
    found = N.fuzzy_manufacturers(spark.createDataFrame([("acme",), ("zetta",), ("none",), (None,), ("",)], "text string"), spark.createDataFrame([(n,) for n in names], "name string"), 60.0).orderBy("text", "rank").collect()
    assert [(r.text, r.name, r.rank) for r in found] == [("acme", n, k + 1) for k, n in enumerate(names[:5])] + [("zetta", "Zeta", 1)]
    assert found[0].score == 100.0


def catalog(spark):
    suppliers = spark.createDataFrame([("SUP016", "LCSC", "China"), ("SUP028", "Other", "Mainland China"), ("SUP030", "Far", "Peru"), ("SUP031", "None", None)], "code string, name string, country string")
    manufacturers = spark.createDataFrame([("Texas Instruments", "United States"), ("NXP Semiconductors", "Netherlands"), ("SMIC", "China"), ("東芝電子", "Japan")], "name string, country string")
    parts = spark.createDataFrame([("ADS1256", "Texas Instruments", "24-bit precision ADC"), ("LM358", "Texas Instruments", ""), ("NE555", "NXP Semiconductors", None), ("SMIC-001", "SMIC", "Chip"), ("T1", "東芝電子", None)], "mpn string, manufacturer string, description string")
    stock = spark.createDataFrame([("SUP016", "ADS1256", "Texas Instruments"), ("SUP016", "NE555", "NXP Semiconductors"), ("SUP030", "LM358", "Texas Instruments"), ("SUP030", "X9", "")], "code string, mpn string, manufacturer string")
    return suppliers, manufacturers, parts, stock


LINK = "set_id string, type string, canonical string, name string, score double, method string, text string, review boolean"


def expanded(spark, *links):
    base = spark.createDataFrame([("s", *link, False) for link in links], LINK)
    suppliers, manufacturers, parts, stock = catalog(spark)
    return {(r.type, r.canonical): r for r in N.expand(base, suppliers, manufacturers, parts, stock).collect()}


def test_a_place_leads_to_parts(spark):
    found = expanded(spark, ("LOCATION", "china", "China", 0.8, "keyword_location", "china"))
    assert {k[1] for k in found if k[0] == "SUPPLIER"} == {"SUP016", "SUP028"} and {k[1] for k in found if k[0] == "MANUFACTURER"} == {"SMIC", "Texas Instruments", "NXP Semiconductors"}
    assert {k[1]: (r.method, r.score, r.text) for k, r in found.items() if k[0] == "COMPONENT"} == {"ADS1256": ("supplier_inventory_map", 0.62, "SUP016"), "NE555": ("supplier_inventory_map", 0.62, "SUP016"), "LM358": ("manufacturer_catalog_map", 0.6, "Texas Instruments"), "SMIC-001": ("manufacturer_catalog_map", 0.6, "SMIC")}
    assert found["SUPPLIER", "SUP016"].name == "LCSC" and found["SUPPLIER", "SUP016"].review and found["MANUFACTURER", "SMIC"].method == "location_manufacturer_map" and not found["LOCATION", "china"].review
    assert expanded(spark, ("LOCATION", "atlantis", "Atlantis", 0.8, "keyword_location", "atlantis")).keys() == {("LOCATION", "atlantis")}


def test_the_best_link_of_an_entity_stays(spark):
    found = expanded(spark, ("COMPONENT", "ADS1256", "ADS1256", 1.0, "exact_mpn", "ADS1256"), ("SUPPLIER", "SUP016", "SUP016", 1.0, "exact_supplier_code", "sup016"), ("LOCATION", "china", "China", 0.8, "keyword_location", "china"))
    assert found["COMPONENT", "ADS1256"].method == "exact_mpn" and found["SUPPLIER", "SUP016"].method == "exact_supplier_code" and found["SUPPLIER", "SUP028"].method == "location_supplier_map"


def test_components_are_capped_by_number(spark):
    many = spark.createDataFrame([("SUP016", f"P{k:04}", "") for k in range(3000)], "code string, mpn string, manufacturer string")
    suppliers, manufacturers, parts, _ = catalog(spark)
    base = spark.createDataFrame([("s", "SUPPLIER", "SUP016", "SUP016", 1.0, "exact_supplier_code", "x", False)], LINK)
    found = [r.canonical for r in N.expand(base, suppliers, manufacturers, parts, many).where("type = 'COMPONENT'").orderBy("canonical").collect()]
    assert found == [f"P{k:04}" for k in range(N.MAX_COMPONENTS)]


def article_links(spark, rows):
    """rows: (article_id, text, metadata)."""
    articles = spark.createDataFrame([(i, t, "", m) for i, t, m in rows], "article_id long, title string, body string, metadata string")
    suppliers, manufacturers, parts, stock = catalog(spark)
    dealt = suppliers.withColumn("dealt_with", F.lit("yes"))
    known = C.mentions(articles, C.gazetteer(dealt, manufacturers.withColumn("alias", F.when(F.col("name") == "Texas Instruments", "TI Works"))))
    told = N.metadata_places(articles)
    mentions = N.extracted(known, told)
    tokens = C.part_links(articles.select("article_id", F.col("title").alias("text_")), parts)
    base = N.base_links(mentions, tokens, told, suppliers, stock.select("manufacturer", "code").where("manufacturer <> ''").distinct(), manufacturers)
    return known, mentions, base


def test_mentions_and_base_links(spark):
    rows = [(1, "Texas Instruments and ADS1256 near Taiwan", '{"country": "taiwan"}'), (2, "Shipments by TI Works halted, sup030 and SUP030 say", '{"raw": {"geo": {"country": "Oman"}}}'), (3, "nothing here", None), (4, "東芝電子 in Asia-Pacific via the Strait of Hormuz", None), (5, None, '{"country": "Iran"}')]
    known, mentions, base = article_links(spark, rows)
    by = lambda df, *c: {tuple(r) for r in df.select("article_id", *c).collect()}
    assert by(known, "type", "canonical") == {(1, "MANUFACTURER", "Texas Instruments"), (1, "LOCATION", "taiwan"), (2, "MANUFACTURER", "Texas Instruments"), (2, "SUPPLIER", "SUP030"), (4, "MANUFACTURER", "東芝電子"), (4, "LOCATION", "Asia-Pacific"), (4, "LOCATION", "strait of hormuz")}
    assert by(mentions.where("confidence > 0.9"), "text", "canonical") == {(2, "oman", "Oman"), (5, "iran", "Iran")}  # a place of the text is no mention again
    found = by(base, "type", "canonical", "method")
    assert found == {
        (1, "MANUFACTURER", "Texas Instruments", "fuzzy_manufacturer"), (1, "SUPPLIER", "SUP016", "manufacturer_supplier_map"), (1, "SUPPLIER", "SUP030", "manufacturer_supplier_map"), (1, "COMPONENT", "ADS1256", "exact_mpn"), (1, "LOCATION", "taiwan", "keyword_location"),
        (2, "SUPPLIER", "SUP030", "exact_supplier_code"), (2, "LOCATION", "oman", "keyword_location"), (4, "MANUFACTURER", "東芝電子", "fuzzy_manufacturer"), (4, "LOCATION", "asia-pacific", "keyword_location"), (4, "LOCATION", "strait of hormuz", "keyword_location"), (5, "LOCATION", "iran", "keyword_location"),
    }
    assert fuzzy.partial_ratio("ti works", "texas instruments") < 75  # an alias unlike its name finds no link, and is told as uncovered
    assert by(N.uncovered(mentions, base.select("article_id", "text")), "text") == {(2, "ti works")}
    assert {r.score for r in base.where("method = 'manufacturer_supplier_map'").collect()} == {0.9}


def test_places_without_mentions_are_injected(spark):
    suppliers, manufacturers, *_ = catalog(spark)
    none = spark.createDataFrame([], "article_id long, text string, type string, canonical string, confidence double")
    told = spark.createDataFrame([(1, "Iran", "geo.country", 0)], "article_id long, label string, source string, ordinal int")
    found = N.base_links(none, spark.createDataFrame([], "article_id long, mpn string"), told, suppliers, spark.createDataFrame([], "manufacturer string, code string"), manufacturers).collect()
    assert [(r.type, r.canonical, r.name, r.score, r.method) for r in found] == [("LOCATION", "iran", "Iran", 0.93, "geo.country")]


def test_equal_base_links_share_a_set(spark):
    *_, base = article_links(spark, [(k, "Texas Instruments in Taiwan" if k % 2 else "SUP016 in Taiwan", None) for k in range(10)])
    of_articles, sets = N.link_sets(base)
    assert of_articles.count() == 10 and sets.select("set_id").distinct().count() == 2 == of_articles.select("set_id").distinct().count()


ENTRIES = "array<struct<id: string, name: string>>"


def sections(spark, links=(), stored=(None,) * 5, analysis=None):
    *_, parts, _ = catalog(spark)
    rows = spark.createDataFrame([("e", *link) for link in links], "event_id string, type string, canonical string, name string")
    kept = spark.createDataFrame([("e", *stored)], "event_id string, " + ", ".join(f"{s} {ENTRIES}" for s in Q.SECTIONS))
    told = spark.createDataFrame([("e", *analysis)] if analysis else [], "event_id string, skipped boolean, affected array<string>")
    r = Q.link_sections(kept.select("event_id"), rows, kept, told, parts).collect()
    assert len(r) == 1
    return {s: [tuple(e) for e in r[0][s]] for s in Q.SECTIONS}


def test_sections_of_links_and_analysis(spark):
    got = sections(spark, [("COMPONENT", "ADS1256", "ADS1256"), ("COMPONENT", "NOPE", "NOPE"), ("SUPPLIER", "SUP016", "LCSC"), ("MANUFACTURER", "TSMC", "TSMC"), ("LOCATION", "tajikistan", "['tajikistan', 'Oman']")], analysis=(False, ["Samsung", "tsmc", "['Intel', 'samsung']", " "]))
    assert got == {"components": [("MPN:ADS1256", "24-bit precision ADC"), ("MPN:NOPE", "NOPE")], "distributors": [("SUP016", "LCSC")], "manufacturers": [("MFR:TSMC", "TSMC")], "affected_manufacturers": [("MFR:TSMC", "TSMC"), ("ai_mfr:samsung", "Samsung"), ("ai_mfr:intel", "Intel")], "locations": [("LOC:tajikistan", "Tajikistan"), ("LOC:tajikistan", "Oman")]}
    assert sections(spark, [("MANUFACTURER", "TSMC", "TSMC")], analysis=(True, ["Samsung"]))["affected_manufacturers"] == [("MFR:TSMC", "TSMC")]
    assert sections(spark) == {s: [] for s in Q.SECTIONS}


def test_stored_sections_go_first(spark):
    stored = ([("mpn:LM358", "LM358"), ("MPN:ADS1256", "Own name"), ("MPN:lm358", "again")], None, [("MFR:Old", "Old"), (None, "new one")], [("x", "Zed"), ("y", "OLD")], [])
    got = sections(spark, [("COMPONENT", "NE555", "NE555"), ("SUPPLIER", "SUP016", "LCSC"), ("MANUFACTURER", "TSMC", "TSMC"), ("LOCATION", "china", "China")], stored)
    assert got == {"components": [("MPN:LM358", "LM358"), ("MPN:ADS1256", "Own name")], "distributors": [("SUP016", "LCSC")], "manufacturers": [("MFR:Old", "Old"), (None, "new one")], "affected_manufacturers": [("x", "Zed"), ("y", "OLD"), ("name:new_one", "new one")], "locations": [("LOC:china", "China")]}


def test_an_event_with_ten_thousand_entries(spark):
    links = [("MANUFACTURER", f"M{k:05}", f"maker {k // 2}" if k % 2 else f"MAKER {k // 2}") for k in range(10_000)]
    got = sections(spark, links)["manufacturers"]
    assert got == [(f"MFR:M{k:05}", f"MAKER {k // 2}") for k in range(0, 10_000, 2)]


def test_backfill_expands_legacy_rows_alone(spark):
    suppliers, manufacturers, parts, stock = catalog(spark)
    rows = [(k, "LOCATION", "china", "China", 0.8, "keyword_location", "china", False) for k in (1, 2, 3)]
    links = spark.createDataFrame(rows, LINK.replace("set_id string", "event_id long"))
    events = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "event_id long, stored boolean")
    of_events, sets = Q.backfilled(links, events, suppliers, manufacturers, parts, stock)
    n = {r.event_id: r.n for r in of_events.join(sets, "set_id").groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 10, 3: 10} and of_events.select("set_id").distinct().count() == 2


def test_merging_a_hot_cluster(spark):
    cols = "article_id long, title string, body string, provider string, tier int, url string, event_category string, event_type string, class_confidence double, severity double, base_severity double, geo_score double, market_score double, geo_country string, metadata string, n_mentions int, mention_confidence double, n_links int, link_score double"
    rows = [(k, "a", "", "gdelt" if k % 2 else "gnews", 1 if k % 2 else 3, f"u{k % 3}" if k % 4 else None, "logistics_disruption", "port_closure", 0.84 if k else 0.5, 70.0 if k == 5 else 55.0, 50.0, 0.0, 70.0, None, None, 2, 0.85, 1, 0.8) for k in range(300)] + [(900, "b", "", "gnews", 3, None, "other", "x", 0.5, 20.0, 30.0, 0.0, 35.0, None, None, 0, 0.0, 0, 0.0)]
    frame = spark.createDataFrame(rows, cols)
    roots = spark.createDataFrame([("a", "a"), ("b", "b")], "title string, root string")
    of_articles = spark.createDataFrame([(k, f"s{k % 2}") for k in range(300)], "article_id long, set_id string")
    links = spark.createDataFrame([("s0", "SUPPLIER", "SUP1", "n", 0.6, "location_supplier_map", "x", True), ("s1", "SUPPLIER", "SUP1", "n", 1.0, "exact_supplier_code", "y", False), ("s1", "LOCATION", "oman", "Oman", 0.8, "keyword_location", "oman", False)], LINK)
    merged = E.merged_links(frame, roots, of_articles, links)
    assert {(r.root, r.canonical, r.method) for r in merged.collect()} == {("a", "SUP1", "exact_supplier_code"), ("a", "oman", "keyword_location")}
    a, b = E.merge_clusters(frame, roots, merged, spark.createDataFrame([("SUP1", 0.9)], "code string, risk double")).orderBy("root").collect()
    assert (a.source_count, a.primary_id, a.n_links, a.link_score, a.supplier_risk, a.urls, a.verification) == (300, 5, 2, 1.0, 0.9, ["u0", "u1", "u2"], 0.701)
    # 50 x .4 + 90 x .15 + 100 x .1 + 40 x .1 + 0 + 70 x .1 + 100 x .05
    assert a.severity == 59.5 and a.severity_summary.startswith("Severity 59.5/100 driven by: base_rule_score (20.0), supplier_criticality (13.5)")
    assert a.review_reasons == [] and a.overall_confidence == pytest.approx(0.84 * 0.35 + 0.25 + 0.85 * 0.15 + 0.825 * 0.15 + 0.0701, abs=6e-4) and a.uncertainties == ""
    assert (b.source_count, b.n_links, b.urls, b.review_reasons, b.uncertainties) == (1, 0, [], ["low_classification_confidence"], "few_sources,low_classification_confidence")
    modes = {r.root: (r.n, r["mode"]) for r in E.cluster_modes(frame.select("article_id", "title", F.when(F.col("article_id") % 2 == 1, "x").otherwise("y").alias("event_category")), roots).collect()}
    assert modes == {"a": (300, "y"), "b": (1, "y")}


def test_answers_of_a_model(spark):
    rows = [(1, '```json\n{"executive_summary": " s ", "affected_manufacturers": ["a", " ", 3], "analysis_confidence": "0.5"}\n```'), (2, '{"executive_summary": 5, "monitoring_actions": "x", "analysis_confidence": 9}'), (3, '{"cut": '), (4, None), (5, "[]"), (6, "")]
    got = {r.event_id: r for r in A.analyses(spark.createDataFrame(rows, "event_id long, content string")).collect()}
    assert [got[k].readable for k in range(1, 7)] == [True, True, False, False, False, False]
    assert (got[1].executive_summary, got[1].affected_manufacturers, got[1].analysis_confidence) == ("s", ["a", "3"], 0.5)
    assert (got[2].executive_summary, got[2].monitoring_actions, got[2].analysis_confidence) == ("5", [], 1.0)
    assert (got[3].executive_summary, got[3].possible_consequences, got[3].analysis_confidence) == ("", [], 0.0)


def test_matches_of_a_model(spark):
    good = {"canonical_id": "MFR:X", "canonical_name": "['x', 'y']", "entity_type": "MANUFACTURER", "match_score": "0.9", "extracted_text": "x co"}
    bad = [{**good, "canonical_id": "UNRESOLVED"}, {**good, "entity_type": "PLANET"}, {**good, "extracted_text": ""}, {k: v for k, v in good.items() if k != "canonical_name"}, 7, None]
    rows = [(1, json.dumps({"matches": [good, {**good, "canonical_id": "SUP1", "canonical_name": "S", "entity_type": "SUPPLIER", "match_score": "high", "requires_review": True}, *bad]})), (2, json.dumps({"matches": "none"})), (3, "broken")]
    found = sorted(tuple(r) for r in A.matches(spark.createDataFrame(rows, "event_id long, content string")).collect())
    assert found == [(1, "MANUFACTURER", "MFR:X", "X", 0.9, "llm", "x co", False), (1, "SUPPLIER", "SUP1", "S", 0.8, "llm", "x co", True)]


def test_a_model_is_asked_in_batches_and_may_fail(spark):
    events = spark.createDataFrame([(k, f"title {k}", [f"u{j}" for j in range(9)] if k else None) for k in range(4)], "event_id long, title string, urls array<string>")
    asked = A.contexts(events, ["title", "urls"], "urls")
    assert json.loads(asked.where("event_id = 1").first().context) == {"title": "title 1", "urls": ["u0", "u1", "u2", "u3", "u4"]} and json.loads(asked.where("event_id = 0").first().context) == {"title": "title 0", "urls": None}
    told = {r.event_id: r.content for r in A.ask(asked.coalesce(1), lambda texts: [None if "title 2" in t else '{"executive_summary": "ok"}' for t in texts]).collect()}
    assert told == {0: '{"executive_summary": "ok"}', 1: '{"executive_summary": "ok"}', 2: None, 3: '{"executive_summary": "ok"}'}

    def broken(texts):
        raise ValueError("no network")

    assert {r.content for r in A.ask(asked, broken).collect()} == {None}


def test_snapshots_and_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [("x", 1.5)], None), (2, None, [], "r")], "id long, name string, links array<struct<n: string, s: double>>, run_id string")
    assert W.write_snapshot(rows, f"file://{tmp_path}/s") and sorted(map(tuple, W.load_snapshot(spark, f"file://{tmp_path}/s", rows).collect())) == sorted(map(tuple, rows.collect()))
    assert not W.write_snapshot(rows.limit(0), f"file://{tmp_path}/none") and not (tmp_path / "none").exists()
    first = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r2"), (4, None)], "id long, run_id string")
    path = f"file://{tmp_path}/runs"
    W.append_run(first, path)
    W.append_run(first.where("run_id = 'r1'"), path)
    W.append_run(spark.createDataFrame([(9, "r2")], "id long, run_id string"), path)
    W.append_run(first.limit(0), path)
    assert sorted((r.id, r.run_id or "") for r in W.read_runs(spark, path, first).collect()) == [(1, "r1"), (2, "r1"), (4, ""), (9, "r2")]
    assert [r.id for r in W.latest(W.read_runs(spark, path, first).where("run_id is not null").withColumn("k", F.lit(1)), ["k"]).collect()] == [9]


def test_counts_are_taken_in_the_pass_that_writes(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    found, counts = counted(spark.range(1000).repartition(4), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    assert counts == {"n": 1000, "even": 500} and found.count() == 1000
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("counted")) <= 4  # the shuffle and the write, and the count above
