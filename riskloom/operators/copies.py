"""Articles that say the same: what depends on what an article says is worked out once, and its rows are given back to each article.

A wording is what texts, provider and metadata tell (mentions, links and relevance depend on it alone), a content is a wording with all
other fields (classes and severity depend on it). Both are told apart by digests; each stands for its articles as the row of the first
one, with copies, the number of its articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDING = ["provider", "tier", "title", "body", "metadata"]
OWN = ("article_id", "published_at", "url")  # an article's own
TOLD = ("geo_country",)  # by the metadata


def _digest(columns: list[str]):
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))  # nulls are left out, and names tell the fields apart


def members(articles: DataFrame) -> DataFrame:
    """(article_id, wording, content, url)."""
    more = [c for c in articles.columns if c not in (*WORDING, *OWN, *TOLD)]
    return articles.select("article_id", _digest(WORDING).alias("wording"), _digest([*WORDING, *more]).alias("content"), "url")


def firsts_of_contents(members: DataFrame) -> DataFrame:
    """(content, wording, article_id, copies): the first article of each content, and how many articles have it."""
    return members.groupBy("content", "wording").agg(F.min("article_id").alias("article_id"), F.count("*").alias("copies"))


def wordings(contents: DataFrame) -> DataFrame:
    """(article_id, wording, copies, provider, tier, title, body, metadata), a row for each wording, of contents (their first articles, with
    content, wording and copies)."""
    firsts = contents.groupBy("wording").agg(F.min("article_id").alias("article_id"), F.sum("copies").alias("copies"))
    return contents.select("article_id", *WORDING).join(firsts.hint("merge"), "article_id")


def of_each(members: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows (key, ...) for every article of the key, with its article_id."""
    return members.select("article_id", key).join(rows.hint("merge"), key).drop(key)
