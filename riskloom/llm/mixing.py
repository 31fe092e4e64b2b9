"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Sources, in the order of their code points (null last), have the weights of a repeating list and share BUDGET of all words by
weight. A target stops at MOST_EPOCHS times its source's words; what it would have had beyond goes to the others by weight until
none is above. That is water filling: sources are sorted by words a weight, and of the sorted list a prefix is full.

Inside a source, each document gets the key -ln(u) / w, where u is a number in (0, 1) drawn from a digest of seed, id and text, and
w the document's quality weight. A source's target is met by complete epochs first. Of what is left, documents are taken in the
order of their keys until their words, summed over the ones before, use it up; the document at the edge is cut there.

Sums over the ones before are taken over a table sorted by ranges and written, so that a source may hold any share of the rows:
each range is summed for itself and begins where the ranges before it, one row each, end. The same holds for the sources.

Defined cases: null and empty texts have size 0 and are taken 0 words of; a null source is one like any other, the last; a quality
weight that is null, NaN or not above zero puts a document after all others of its source; repeated rows get a row each and are
drawn alike, so the rest of them are the same whichever is cut; an empty table gives an empty result; extra columns are not read.
Texts of any length are read whole. Reruns and other partitionings agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import read_table, saved

WEIGHTS, BUDGET, MOST_EPOCHS, SEED = (5, 2, 1), (3, 2), 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_QUALITY, USUAL_WORD, SPREAD = 0.05, 6.5, 10.0
NO_SOURCE, SOURCE = "_no_source", "_source"  # a source as keys that are never null


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 where words with the space after them have their usual mean length, less the further from it, LEAST_QUALITY at least."""
    apart = F.abs(F.length(text) / size - USUAL_WORD)
    return F.when(size > 0, F.greatest(F.lit(LEAST_QUALITY), 1.0 - apart / SPREAD)).otherwise(LEAST_QUALITY)


def uniform(text: Column) -> Column:
    """A number in (0, 1) from 52 bits of the text's digest."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sums_before(df: DataFrame, order: list[str], value: str, within: list[str]) -> DataFrame:
    """df with before, the sum of value over the rows of the same within that come earlier in order (which begins with within)."""
    rows = saved(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "mix-sorted")
    past = (Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range", *within).agg(F.sum(value).alias("_total"))
    earlier = F.sum("_total").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(*past))
    starts = totals.select("_range", *within, F.coalesce(earlier, F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(*past))
    summed = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(starts, ["_range", *within])
    return summed.withColumn("before", F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (NO_SOURCE, SOURCE, source_size) with target. budget is a fraction of all words, below most."""
    one = lambda df: df.withColumn("_all", F.lit(1))
    ranked = sums_before(one(sources).withColumn("_one", F.lit(1)), [NO_SOURCE, SOURCE], "_one", ["_all"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.select(NO_SOURCE, SOURCE, "source_size", weight.alias("weight")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    both = F.struct(F.col("weight").alias("w"), F.col("source_size").alias("n"))
    sorted_ = weighed.withColumn("_both", both)
    order = ["_all", "ratio", NO_SOURCE, SOURCE]
    filled = sums_before(one(sorted_.drop("_both")), order, "weight", ["_all"]).withColumnRenamed("before", "w_before")
    filled = sums_before(filled, order, "source_size", ["_all"]).withColumnRenamed("before", "n_before")
    filled = saved(filled, "mix-sources")
    total = filled.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not total["w"]:
        return filled.select(NO_SOURCE, SOURCE, "source_size", F.lit(0.0).alias("target"))
    up, down = budget
    # a source is full if its words times most are not above its share of what the smaller ones leave; numbers are whole times down
    left = F.lit(up * total["n"]) - F.lit(down * most) * F.col("n_before")
    full = F.col("source_size").cast("double") * (down * most) * (F.lit(total["w"]) - F.col("w_before")) <= F.col("weight") * left.cast("double")
    of_full = filled.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    share = F.col("weight") * F.lit(up * total["n"] - down * most * of_full["n"]) / F.lit(float(down * max(total["w"] - of_full["w"], 1)))
    return filled.select(NO_SOURCE, SOURCE, "source_size", F.when(full, F.col("source_size") * float(most)).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row: the words that the mix takes of it, repeats counted. quality is
    a column of docs, else quality_weight of the text."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), text.alias("_text"), *([quality.cast("double").alias("_w")] if quality is not None else []))
    sized = given.withColumn("size", word_count(F.col("_text")))
    weight = F.col("_w") if quality is not None else quality_weight(F.col("_text"), F.col("size"))
    drawn = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("_text", F.lit("")))
    sized = sized.withColumns({"_w": weight, "_u": uniform(drawn)})
    keyed = saved(sized.select("doc_id", "source", "size", F.when(F.col("_w") > 0, F.when(~F.isnan("_w"), -F.log("_u") / F.col("_w"))).alias("key"), "_u", F.col("source").isNull().alias(NO_SOURCE), F.coalesce("source", F.lit("")).alias(SOURCE)), "mix-keys")
    sources = keyed.groupBy(NO_SOURCE, SOURCE).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, budget, most)
    rows = sums_before(keyed.withColumns({"_last": F.col("key").isNull(), "key": F.coalesce("key", F.lit(0.0))}), [NO_SOURCE, SOURCE, "_last", "key", "_u", "doc_id", "size"], "size", [NO_SOURCE, SOURCE])
    joined = rows.join(targets, [NO_SOURCE, SOURCE])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, epoch, n_words, text) of the mix: a row for each time a document is taken, whole in all epochs but the last, of which
    the first words stand where it is cut. docs has one row an id; taken is the result of mix_sources."""
    words = F.col("taken") - F.col("epoch") * F.col("size")
    each = taken.where("taken > 0").select(F.col("doc_id").alias(id_col), "size", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))).alias("epoch")).withColumn("n_words", F.least("size", words))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), 0), F.lit(1), F.col("n_words").cast("int")), " ")
    return each.join(docs.select(id_col, text_col), id_col).select(id_col, "epoch", "n_words", F.when(F.col("n_words") < F.col("size"), cut).otherwise(F.col(text_col)).alias(text_col))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = f"""
WITH d0 AS (
    SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents
), d AS (
    SELECT doc_id, source, size, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)
        / CASE WHEN size > 0 THEN greatest({LEAST_QUALITY}::DOUBLE, 1.0::DOUBLE - abs(length(text)::DOUBLE / size - {USUAL_WORD}::DOUBLE) / {SPREAD}::DOUBLE) ELSE {LEAST_QUALITY}::DOUBLE END AS key FROM d0
), s AS (
    SELECT source, sum(size)::BIGINT AS n, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source
), f AS (
    SELECT *, sum(w) OVER () AS all_w, sum(n) OVER () AS all_n, sum(w) OVER (ORDER BY n / w, source NULLS LAST) - w AS w_before, sum(n) OVER (ORDER BY n / w, source NULLS LAST) - n AS n_before FROM s
), g AS (
    SELECT *, n * {BUDGET[1] * MOST_EPOCHS}::DOUBLE * (all_w - w_before) <= w * ({BUDGET[0]} * all_n - {BUDGET[1] * MOST_EPOCHS} * n_before)::DOUBLE AS is_full FROM f
), t AS (
    SELECT source, n, CASE WHEN is_full THEN n * {MOST_EPOCHS}::DOUBLE ELSE (w * ({BUDGET[0]} * all_n - {BUDGET[1] * MOST_EPOCHS} * coalesce(sum(n) FILTER (is_full) OVER (), 0)))::DOUBLE / ({BUDGET[1]} * (all_w - coalesce(sum(w) FILTER (is_full) OVER (), 0)))::DOUBLE END AS target FROM g
), k AS (
    SELECT doc_id, size, n AS source_size, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS epochs, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM k
"""
