"""Indel similarity of strings, as Arrow-batched UDFs; Spark has only Levenshtein's metric."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 x LCS over both lengths; two empty strings are alike."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string to a window of the longer, windows cut at its ends included; of two of one length either is the shorter."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)))
    return max(best, max(ratio(long, short[max(0, k) : k + n]) for k in range(1 - n, n))) if n == len(long) else best


def _column(score, a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else score(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return _column(ratio, a, b)


def indel_partial_ratio(a: Column, b: Column) -> Column:
    return _column(partial_ratio, a, b)


def alike_pairs(texts: DataFrame, least: float = 88.0) -> DataFrame:
    """(block, a, b) of the distinct texts (block, text) of a block whose Indel ratio is at least that, each pair both ways and each
    text with itself. At most (1 - least / 100) of both lengths are insertions and deletions, each of which takes two pairs of
    neighbouring characters at most; so two such texts share one of each one's rarest character pairs, and only those are joined."""
    slack = 1 - least / 100
    ratio_of_lengths = (1 - slack) / (1 + slack)
    texts = texts.select("block", "text").distinct()
    grams = texts.select("block", "text", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2)))")).alias("g"))
    ranked = grams.join(grams.groupBy("block", "g").agg(F.count("*").alias("n")), ["block", "g"]).groupBy("block", "text").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("r"))
    lost = F.floor(2 * slack * F.length("text") * (1 + 1 / ratio_of_lengths) + 1e-9).cast("int")  # pairs that may be missing in the other text
    keyed = ranked.select("block", "text", F.explode(F.slice("r", F.lit(1), F.least(F.size("r"), lost + 1))).alias("x")).select("block", "text", F.col("x.g").alias("g"))
    near = keyed.withColumnRenamed("text", "a").join(keyed.withColumnRenamed("text", "b"), ["block", "g"]).where("a < b").where(F.least(F.length("a"), F.length("b")) >= ratio_of_lengths * F.greatest(F.length("a"), F.length("b")) - 1e-9).select("block", "a", "b").distinct()
    found = near.where(indel_ratio(F.col("a"), F.col("b")) >= least)
    return found.unionByName(found.select("block", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(texts.select("block", F.col("text").alias("a"), F.col("text").alias("b")))


def partial_keys(text: Column, least: float) -> tuple[Column, Column]:
    """(asked, offered): what a text asks for as the shorter of a pair, in how many rarest of which one has to be found, and what it offers as
    the longer. With r = least / 100, the best window has w characters, a common subsequence of L >= r (n + w) / 2 <= w with the n of
    the shorter, so w >= r n / (2 - r). n - L characters are lost and w - L come between, which breaks 2 (n - L) + (w - L) pairs
    of neighbours at most, and that is greatest at one end of w's range. Where n - 1 pairs are more than that, pairs are asked for, else
    characters, of which n - L <= n (1 - r / (2 - r)) are lost."""
    r = least / 100
    share = r / (2 - r)
    broken = max((2 - 1.5 * r) + w * (1 - 1.5 * r) for w in (share, 1.0))
    n = F.length(text)
    pairs = F.expr("array_distinct(transform(sequence(1, greatest(length({0}) - 1, 1)), i -> substring({0}, i, 2)))".format("`_t`"))
    letters = F.expr("array_distinct(transform(sequence(1, greatest(length({0}), 1)), i -> substring({0}, i, 1)))".format("`_t`"))
    lost = F.floor(n * broken + 1e-9).cast("int")
    by_pairs = n - 1 > lost
    tagged = lambda rows, kind: F.transform(rows, lambda x: F.concat(F.lit(kind), x))
    asked = F.when(by_pairs, F.struct((lost + 1).alias("n"), tagged(pairs, "2").alias("keys"))).otherwise(F.struct((F.floor(n * (1 - share) + 1e-9).cast("int") + 1).alias("n"), tagged(letters, "1").alias("keys")))
    return asked, F.concat(tagged(letters, "1"), tagged(pairs, "2"))


def partial_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of the texts of left and right (columns text) whose partial ratio is at least that, by an equi-join that loses none: the
    shorter asks for its rarest keys, the longer offers all of its own. Only candidates meet the ratio itself."""
    sides = {}
    for name, df in (("l", left), ("r", right)):
        texts = df.select(F.col("text").alias("_t")).where("_t <> ''").distinct()
        asked, offered = partial_keys(F.col("_t"), least)
        sides[name] = texts.select("_t", asked.alias("ask"), offered.alias("offer"))
    rarity = sides["l"].select(F.explode("offer").alias("k")).unionByName(sides["r"].select(F.explode("offer").alias("k"))).groupBy("k").agg(F.count("*").alias("df"))
    found = []
    for short, long in (("l", "r"), ("r", "l")):
        keys = sides[short].select("_t", "ask.n", F.explode("ask.keys").alias("k")).join(rarity, "k").groupBy("_t", "n").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ks"))
        ask = keys.select(F.col("_t").alias("s"), F.explode(F.slice("ks", F.lit(1), F.greatest(F.lit(1), F.least(F.size("ks"), F.col("n"))))).alias("x")).select("s", "x.k")
        offer = sides[long].select(F.col("_t").alias("t"), F.explode("offer").alias("k"))
        pairs = ask.join(offer, "k").where(F.length("s") <= F.length("t")).select("s", "t").distinct()
        found.append(pairs.select(F.col("s" if short == "l" else "t").alias("a"), F.col("t" if short == "l" else "s").alias("b")))
    both = found[0].unionByName(found[1]).distinct()
    return both.withColumn("score", indel_partial_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
