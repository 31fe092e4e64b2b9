"""Joins of tables that grow with the articles: none is sent whole through the driver, however small its files look."""

import re

from riskloom.operators import catalog as C
from riskloom.operators import events as E
from riskloom.operators import scoring as S
from riskloom.plans.lineage import saved
from riskloom.plans.queries import QUERIES, Tables


def broadcast_keys(df):
    return re.findall(r"BroadcastHashJoin \[(\w+?)#", df._jdf.queryExecution().sparkPlan().toString())


def test_articles_are_not_broadcast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    t.hits = S.term_places(t.articles.select("article_id", S.article_text(t.articles).alias("text_")), S.relevance_terms(t.manufacturers, t.categories), "article_id", "term")
    assert "article_id" not in broadcast_keys(t.hits)
    assert "article_id" not in broadcast_keys(t.scored)


def test_orders_are_not_broadcast(spark, sf_dir):
    keys = broadcast_keys(Tables(spark, sf_dir).stock)
    assert "l_orderkey" not in keys and "mpn" not in keys


def test_links_are_summed_by_set(spark, sf_dir):
    t = Tables(spark, sf_dir)
    t.link_tables = (
        spark.createDataFrame([(1, "s"), (2, "s"), (3, "z")], "article_id long, set_id string"),
        spark.createDataFrame([("s", "COMPONENT", c, c, 0.6, "exact_mpn", c, c == "B") for c in "BA"] + [("z", "LOCATION", "x", "X", 0.8, "metadata", "X", True)], "set_id string, type string, canonical string, name string, score double, method string, text string, review boolean"),
    )
    df = QUERIES["expanded_links"](t)
    assert sorted(map(tuple, df.collect())) == [(1, "COMPONENT", "exact_mpn", 2, "A", "B", "A", 0.6, 1), (2, "COMPONENT", "exact_mpn", 2, "A", "B", "A", 0.6, 1), (3, "LOCATION", "metadata", 1, "x", "x", "X", 0.8, 1)]
    keys = re.findall(r"Aggregate \[(\w+?)#", df._jdf.queryExecution().optimizedPlan().toString())
    assert keys == ["set_id"]  # an article's links are not gathered again where another has the same set


def test_clusters_read_the_articles_once(spark, sf_dir, monkeypatch):
    seen = []
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("event_id#")
    monkeypatch.setattr(E, "saved", lambda df: seen.append(reads(df)) or saved(df))
    E.clusters(Tables(spark, sf_dir).articles)
    assert seen[0] > 0 and not any(seen[1:])


def test_backfill_gathers_links_once_and_sends_no_events_around(spark, sf_dir, monkeypatch):
    from riskloom.operators import linking as N

    seen = []
    monkeypatch.setattr(N, "saved", lambda df: seen.append(broadcast_keys(df)) or saved(df))
    gathered = []
    monkeypatch.setattr(N, "best_of", lambda links, *keys, real=N.best_of: gathered.append(keys) or real(links, *keys))
    df = QUERIES["backfill"](Tables(spark, sf_dir))
    assert not any("event_id" in keys for keys in [*seen, broadcast_keys(df)])
    assert [keys for keys in gathered if "event_id" in keys] == [("event_id", "stored")]


def test_holdings_are_told_apart_before_parts_are_joined(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = C.holdings(t.inventory, t.distributors, t.parts)
    assert sorted(found.collect()) == sorted(t.stock.select(found.columns).distinct().collect())
    assert len(set(found.collect())) == found.count()
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin [mpn#" in plan  # stock is sorted nowhere
