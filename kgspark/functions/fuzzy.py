"""Similar titles: longest-common-subsequence ratio, and a candidate join that loses no pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel length of a longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        match = row & places.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 LCS / (length sum): 100 for equal strings, and for two empty ones."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _grams(df: DataFrame, text: str, loss: float) -> DataFrame:
    """The rare-first prefix of each text's (bigram, occurrence) tokens that a pair within the loss must share a token of."""
    n = F.length(text)
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col(text), i, 2))
    # (bigram, how manieth in this text)
    numbered = F.transform(bigrams, lambda g, i: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(bigrams, 1, i + 1), lambda x: x == g)).cast("string")))
    longest = n + F.floor(n * ((1 + loss) / (1 - loss)))
    keep = 2 * F.floor(loss * longest) + 1
    rows = df.select(text, F.explode(numbered).alias("gram"), keep.alias("keep"))
    rare = rows.groupBy("gram").agg(F.count("*").alias("frequency"))
    w = W.partitionBy(text).orderBy("frequency", "gram")
    return rows.join(rare, "gram").withColumn("at", F.row_number().over(w)).where("at <= keep").select(text, "gram", "frequency")


def similar_pairs(left: DataFrame, right: DataFrame | None, least: float, strict: bool, length_gap: int | None = None, text: str = "title", block: int = 1024) -> DataFrame:
    """(a, b, score) with ratio >= least (> if strict), of distinct texts; right None: pairs a < b of left itself.

    Candidates share one of the rarest bigrams of each and have lengths that
    allow the ratio; each is then verified by its LCS. No pair is lost: a ratio
    of least bounds the number of edits, each of which spoils two bigrams. The
    index is cut by length: texts of a pair lie in the same or in adjacent cells.
    A bigram of more than `block` texts is dealt into squares, so that a key
    pairs about block texts with as many, however common it is.
    """
    loss = 1 - least / 100
    l = left.select(F.col(text).alias("a")).where("a <> ''").distinct()
    r = l if right is None else right.select(F.col(text).alias("a")).where("a <> ''").distinct()
    both = l.unionByName(r).distinct()
    grams = _grams(both, "a", loss)
    ga = grams.join(l, "a", "left_semi") if right is not None else grams
    gb = (grams.join(r, "a", "left_semi") if right is not None else grams).withColumnRenamed("a", "b")
    low = F.least(F.length("a"), F.length("b"))
    high = F.greatest(F.length("a"), F.length("b"))
    near = (low * (2 - least / 100) >= high * (least / 100) - 1e-9) & ((F.col("a") < F.col("b")) if right is None else F.lit(True))
    if length_gap is not None:
        near = near & (high - low <= length_gap)
    # lengths of a pair differ by this factor at most; the added part keeps rounding on the near side
    factor = math.log((2 - least / 100) / (least / 100)) + 1e-9
    cell = lambda c: F.floor(F.log(F.length(c)) / F.lit(factor))
    squares = F.ceil(F.col("frequency") / F.lit(block))
    place = lambda c: F.pmod(F.xxhash64(c), squares)
    every = F.explode(F.sequence(F.lit(0).cast("long"), squares - 1))
    ga = ga.select("a", "gram", cell("a").alias("cell"), place("a").alias("x"), every.alias("y"))
    gb = gb.select("b", "gram", F.explode(F.array(*[cell("b") + d for d in (-1, 0, 1)])).alias("cell"), place("b").alias("y"), squares.alias("squares"))
    gb = gb.select("b", "gram", "cell", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("squares") - 1)).alias("x"))
    pairs = ga.join(gb, ["gram", "cell", "x", "y"]).where(near).select("a", "b").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            score = [ratio(a, b) for a, b in zip(x["a"], x["b"])]
            y = x.assign(score=score)
            yield y[y["score"] > least if strict else y["score"] >= least]

    # pairs are few bytes but much work: dealt to as many tasks as there are, they are not put together by size
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "a", "b").mapInPandas(verify, "a string, b string, score double")


def normalize_title(title: Column) -> Column:
    """Lower case, one space for white space, none at the ends, one plural s dropped (not of ss, nor of three letters or fewer)."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)


def strip(text: Column) -> Column:
    """Without white space at the ends, of any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
