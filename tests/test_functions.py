import json
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import fuzzy
from riskloom.functions import text as X
from riskloom.operators import catalog as C
from riskloom.operators import events as E
from riskloom.operators import scoring as S
from riskloom.sources import providers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fingerprint_and_id(spark):
    print_ = X.fingerprint(F.lit("Strait of Hormuz closure"), F.lit("logistics_disruption"), F.lit("Oman"))
    assert one(spark, print_) == "e0f18547f5df8c6730fafc43f1002ad686ef199ce4cc7fb49aca6662b785bb37"
    assert one(spark, X.stable_id(print_)) == "b777f7a7-39cf-58dc-8a60-6cef6503b1f8"


def test_indel():
    assert fuzzy.ratio("port closure", "port closures") == 96.0
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)
    assert fuzzy.partial_ratio("fire", "a fire at the fab") == 100.0 and fuzzy.ratio("", "") == 100.0


def test_text(spark):
    assert one(spark, X.normalize_title(F.lit("Hello, Wörld!  "))) == "hello wörld"
    assert one(spark, X.truncate(F.lit("hello world"), 8)) == "hello..."
    assert one(spark, X.clean_summary(F.lit("A fire. [...]"))) == "A fire."
    assert one(spark, X.mpn_of(F.lit("mpn:LM358"))) == "LM358"
    assert one(spark, X.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, X.preview(F.lit("one two, three"), 10)) == "one two…"
    assert one(spark, X.title_similarity(F.lit("Fab fire in Taiwan"), F.lit("Taiwan fab fire"))) == pytest.approx(0.925)


def test_clusters(spark):
    titles = ["Port closure disrupts chip shipments", "Port closure disrupts shipments of chip", "port closure disrupts chip shipments", "Fab fire in Taiwan", "Taiwan fab fire", "Earthquake hits Japan"]
    df = spark.createDataFrame(list(enumerate(titles)), "article_id long, title string")
    roots = {r.title: r.root for r in E.clusters(df).collect()}
    assert [roots[t] for t in titles] == [titles[0]] * 3 + [titles[3]] * 2 + [titles[5]]


def scored(spark, rows, manufacturers=(("Texas Instruments", "US", "TI Works"), ("STM32-F4", "US", "F4"), ("NXP Semiconductors", "NL", None)), categories=("power modules", "Upper Case")):
    cols = "article_id long, provider string, title string, body string, metadata string"
    frame = S.relevance(spark.createDataFrame(rows, cols), spark.createDataFrame(list(manufacturers), "name string, country string, alias string"), spark.createDataFrame([(c,) for c in categories], "term string"))
    return {r.article_id: r for r in frame.collect()}


def test_relevance_golden(spark):
    rows = [
        (1, "gnews", "new ic", "", None), (2, "gnews", "football ic", "", None), (3, "newsdata", "nothing", "here", None), (4, "gdelt", "ic", "", '{"x": "outage"}'), (5, "gdacs", "x", "y", None), (6, "gnews", None, None, None),
        (7, "gdelt", "ic", "", '{"x": "supplier"}'), (8, "gdelt", "none", "", '{"x": "export ban", "y": "ic"}'), (9, "gdelt", "war", "", '{"x": "ic"}'), (10, "gdelt", "new ic", "", '{"code": 1}'),
        (11, "gdelt", "new ic", "", '{"event_code": "in02"}'), (12, "gdelt", "new ic", "", '{"raw": {"event_code": "IN02"}}'), (13, "gdelt", "new", "", '{"event_code": "EX01"}'), (14, "gnews", "called now", "", None),
    ]
    got = scored(spark, rows)
    want = {1: (0.25, "keyword_entity_score"), 2: (0.0, "negative_keyword_match"), 3: (0.12, "no_keyword_or_entity_match"), 4: (0.352, "keyword_entity_score"), 5: (1.0, "provider_auto_pass"), 6: (0.0, "empty_content"), 7: (0.358, "keyword_entity_score"), 8: (0.228, "keyword_entity_score"), 9: (0.30, "keyword_entity_score"), 10: (0.25, "keyword_entity_score"), 11: (0.40, "keyword_entity_score"), 12: (0.25, "keyword_entity_score"), 13: (0.15, "keyword_entity_score"), 14: (0.12, "no_keyword_or_entity_match")}
    assert {k: (r.score, r.reason) for k, r in got.items()} == want
    assert got[11].matched == "semiconductor:ic,metadata:gdelt_event_code:IN02" and got[13].matched == "metadata:gdelt_event_code:EX01"


def test_names_of_several_words(spark):
    got = scored(spark, [(1, "gnews", "Texas Instruments, power modules", "", None), (2, "gnews", "the texas instrumentsx", "upper case", None), (3, "gnews", "an STM32-F4 part of TI works", "", None), (4, "gnews", "(NXP Semiconductors)", "", None)])
    assert got[1].matched == "manufacturer:Texas Instruments,category:power modules,signal:manufacturer_category_cooccurrence,signal:strong_context" and got[1].exact == pytest.approx(0.35 + 0.20 + 0.20 + 0.10)
    assert got[2].matched == "" and got[3].manufacturers_found == "STM32-F4,TI Works" and got[4].manufacturers_found == "NXP Semiconductors"
    names = spark.createDataFrame([("Texas Instruments", "TI", "MANUFACTURER"), ("red sea", "red sea", "LOCATION"), ("sea", "red sea", "LOCATION")], "surface string, canonical string, type string")
    from riskloom.operators.catalog import mentions

    found = mentions(spark.createDataFrame([(1, "In the Red Sea, Texas  Instruments", "Texas Instruments")], "article_id long, title string, body string"), names).collect()
    assert {(r.canonical, r.start, r.end) for r in found} == {("red sea", 7, 14), ("TI", 35, 52)}


def test_similar_titles_by_brute_force(spark):
    rnd = random.Random(1)
    words = ["the", "a", "of", "in", "fire", "fab", "port", "chip", "strike", "flood", "taiwan", "ship"]
    titles = list(dict.fromkeys(" ".join(rnd.choices(words[: rnd.choice([4, 12])], k=rnd.randint(1, 6))) for _ in range(150)))
    frame = spark.createDataFrame(list(enumerate(titles)), "ordinal long, title string")
    got = {(r.a, r.b) for r in E.similar_titles(frame).collect()}

    def similarity(a, b):
        wa, wb = set(a.split()), set(b.split())
        ca, cb = wa - set(words[:4]), wb - set(words[:4])
        j = len(wa & wb) / len(wa | wb)
        return 0.3 * j + 0.7 * (len(ca & cb) / len(ca | cb) if ca and cb else j)

    assert got == {(a, b) for i, a in enumerate(titles) for b in titles[i + 1 :] if similarity(a, b) >= 0.75}


def test_alike_pairs_by_brute_force(spark):
    rnd = random.Random(2)
    texts = set()
    for _ in range(40):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 30)))
        texts |= {base, base[1:], base.replace("a", "b", 1), base[: len(base) // 2] + "x" + base[len(base) // 2 :]}
    frame = spark.createDataFrame([("k", t) for t in texts if t], "block string, text string")
    got = {(r.a, r.b) for r in fuzzy.alike_pairs(frame).collect()}
    assert got == {(a, b) for a in texts for b in texts if a and b and fuzzy.ratio(a, b) >= 88}


def test_fuzzy_identity_in_order(spark):
    rnd = random.Random(3)
    titles = ["port closure at rotterdam", "port closures at rotterdam", "port closure in rotterdam", "fab fire in taiwan today", "fab fires in taiwan today", "", "strike"]
    rows = [(k, rnd.choice(titles), rnd.choice(["x", "y"]), rnd.choice(["US", "NL"]), k % 4 == 0) for k in range(60)]
    frame = E.with_identity(spark.createDataFrame(rows, "event_id long, title string, event_category string, geo_country string, old boolean"), "title", "event_category", "geo_country")
    prints = {r.event_id: r.fingerprint for r in frame.collect()}
    index = [(i, t, c, prints[i], i) for i, t, c, _, old in rows if old]
    want, olds = {}, list(index)
    for i, t, c, _, old in rows:
        if old:
            continue
        match = next((r for r in olds if r[3] == prints[i]), None) or next((r for r in index if r[2] == c and r[1] and t and fuzzy.ratio(r[1], t) >= 88), None) or next((r for r in index if not t and r[3] == prints[i]), None)
        want[i] = (match[4], "updated") if match else (i, "detected")
        index.append((i, t, c, prints[i], want[i][0]))
    got = {r.event_id: (r.resolved_id, r.new_status) for r in E.resolve_identity_fuzzily(frame.where("not old"), frame.where("old")).collect()}
    assert got == want


def test_sentences_and_labels(spark):
    assert one(spark, X.humanized(F.lit("Event type: EQ. Alert level: orange. Country: Japan. Severity: Magnitude 6.2M, Depth:10km. ..."))) == "A magnitude 6.2 earthquake was detected in Japan at a depth of 10 km. GDACS has issued a Orange alert."
    assert one(spark, X.alert_sentence(F.lit("wf"), F.lit(""), F.lit(None).cast("string"), F.lit("high "))) == "A wildfire event was reported with severity high."
    assert one(spark, X.geo_label(F.lit("['united arab emirates']"))) == "United Arab Emirates" and one(spark, X.geo_label(F.lit("  "))) is None
    assert one(spark, X.labels(F.lit("['oman', \"Oman\", 'US']"))) == ["Oman", "US"] and one(spark, X.summary_field(F.lit("A: 1. a: 2."), "a")) == "2"


def test_upsert_of_some_columns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "event_id long, title string, severity double")
    new = spark.createDataFrame([(2, "c", 5.0), (2, "c", 4.0), (3, "d", 3.0)], "event_id long, title string, severity double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(E.upsert(old, new)) == [(1, "a", 1.0), (2, "c", 5.0), (3, "d", 3.0)] and rows(E.upsert(old, new, update=["severity"])) == [(1, "a", 1.0), (2, "b", 5.0), (3, "d", 3.0)]


def test_providers(spark, tmp_path):
    payloads = {
        "gdacs": {"features": [{"properties": {"eventid": 5, "eventtype": "EQ", "name": "Earthquake in Taiwan", "alertlevel": "Orange", "country": "Taiwan", "fromdate": "2024-01-02T03:04:05", "severitydata": {"severity": 6.2, "severitytext": "6.2M"}, "url": {"report": "u"}}}, {"properties": {"name": "no id"}}]},
        "marketaux": {"data": [{"uuid": "a", "title": "Supplier bankruptcy filing", "url": "u", "published_at": "bad", "entities": [{"sentiment_score": -0.4}, {"sentiment_score": None}]}]},
        "newsdata": {"results": [{"title": "Export controls", "description": "d", "link": "l", "pubDate": "2024-01-02T03:04:05Z", "language": "en"}]},
    }
    for name, payload in payloads.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    rows = {r.provider: r for r in providers.ingest(spark, {n: f"{tmp_path}/{n}.json" for n in payloads} | {"other": "x"}).collect()}
    assert len(rows) == 3 and rows["gdacs"].magnitude == 6.2 and rows["marketaux"].sentiment == -0.4 and rows["marketaux"].published_at is None and rows["newsdata"].published_at is not None


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"run_id": "r1", "risk_events": [{"event_id": "a", "title": "t", "severity_score": 5.0}, {"event_id": "b", "run_id": "r0"}]}))
    assert {r.event_id: r.run_id for r in E.read_snapshot(spark, f"{tmp_path}/s.json").collect()} == {"a": "r1", "b": "r0"}
    (tmp_path / "bad.json").write_text("[1, 2")
    assert E.read_snapshot(spark, f"{tmp_path}/bad.json").count() == 0


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        E.page(spark.range(1), 201)


def test_stream(spark, tmp_path):
    from riskloom.streaming.live import append_to, new_events

    rows = spark.sql("SELECT 'Fire' AS title, 'other' AS event_category, 'X' AS geo_country, timestamp'2024-01-01 00:00:00' AS retrieved_at UNION ALL SELECT 'fire!', 'other', 'x', timestamp'2024-01-01 00:01:00'")
    rows.write.parquet(f"{tmp_path}/in")
    query = append_to(new_events(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_insert_missing(spark):
    schema = "event_id long, article_id string, title string"
    old = spark.createDataFrame([(1, "a", "kept"), (None, "a", "old")], schema)
    new = spark.createDataFrame([(1, "a", "new"), (1, "b", "y"), (1, "b", "x"), (None, "a", None), (2, None, "z")], schema)
    got = [tuple(r) for r in E.insert_missing(old, new, ["event_id", "article_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", "kept"), (None, "a", "old"), (1, "b", "x"), (None, "a", None), (2, None, "z")], key=str)
    assert E.insert_missing(old, new.limit(0), ["event_id", "article_id"]).count() == 2


def test_part_links(spark):
    texts = spark.createDataFrame([(1, "stm32-f4 and LM358/N, lm358/n; AB12 éSTM32-F4"), (2, "xSTM32-F4, STM32-F4x"), (3, None), (4, "NE5_55.")], "article_id long, text_ string")
    parts = spark.createDataFrame([("STM32-F4",), ("LM358/N",), ("AB12",), ("NE5_55",), ("stm32-f4",), (None,), ("LM358/N",)], "mpn string")
    assert sorted(tuple(r) for r in C.part_links(texts, parts).collect()) == [(1, "LM358/N"), (1, "STM32-F4"), (4, "NE5_55")]


def test_upsert_results(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "event_id long, result string")
    new = spark.createDataFrame([(1, "x", True), (2, None, False), (3, "y", None), (4, "z", False), (5, "w", True)], "event_id long, result string, skipped boolean")
    assert sorted(tuple(r) for r in E.upsert_results(old, new).collect()) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]


def test_reads_have_flags_bounds_and_order(spark):
    events = spark.createDataFrame([(1, "a", "detected", 10.0, "r1"), (2, "b", "updated", 90.0, "r2"), (3, "a", "detected", None, None)], "event_id long, event_category string, status string, severity double, run_id string")
    results = spark.createDataFrame([(1,), (1,), (9,)], "event_id long")
    flagged = E.with_flags(events, results, results.limit(0))
    assert {(r.event_id, r.has_analysis, r.has_prediction) for r in flagged.collect()} == {(1, True, False), (2, False, False), (3, False, False)}
    whole = [r for r in E.summary(flagged).collect() if r.kind == "all"][0]
    assert (whole.n, whole.max_severity, whole.with_analysis, whole.with_prediction) == (3, 90.0, 1, 0)
    assert [r.run_id for r in E.runs(events).collect()] == ["unknown", "r2", "r1"]
    assert E.list_events(events, min_severity=0.0).count() == 3
    for bad in (-1.0, 101.0):
        with pytest.raises(ValueError, match="min_severity"):
            E.list_events(events, min_severity=bad)
