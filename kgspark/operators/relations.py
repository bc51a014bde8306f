"""Relations: mapping names to canonical titles, counting, orphans, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.functions.fuzzy import normalize_title, similar_pairs, strip
from kgspark.sources.checkpoints import stored


def map_names(names: DataFrame, mapping: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(name, mapped, how): by the stripped lower-cased name, else by its normalized form, else by the most similar key over 84.5."""
    m = mapping.select(F.col("name").alias("key"), F.col("title").alias("mapped"), "first_place")
    asked = names.select("name").where("name is not null and name <> ''").distinct().select("name", strip(F.lower("name")).alias("low"), normalize_title(F.col("name")).alias("norm"))
    k1 = m.select(F.col("key").alias("low"), F.col("mapped").alias("m1"))
    k2 = m.select(F.col("key").alias("norm"), F.col("mapped").alias("m2"))
    # written once: hits, candidates and what is left read it again
    staged = stored(asked.join(k1, "low", "left").join(k2, "norm", "left"), "asked")
    hit = staged.where("m1 is not null or m2 is not null").select("name", F.coalesce("m1", "m2").alias("mapped"), F.when(F.col("m1").isNotNull(), "lower").otherwise("normalized").alias("how"))
    rest = staged.where("m1 is null and m2 is null").select("name", "norm")
    if not fuzzy:
        return hit.unionByName(rest.select("name", F.lit(None).cast("string").alias("mapped"), F.lit("none").alias("how")))
    pairs = similar_pairs(rest.select(F.col("norm").alias("title")), m.select(F.col("key").alias("title")), 84.5, True)
    w = W.partitionBy("a").orderBy(F.desc(F.bround("score")), "first_place")
    best = pairs.join(m, pairs.b == m.key).withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("a").alias("norm"), F.col("mapped"))
    found = rest.join(best, "norm", "left").select("name", "mapped", F.when(F.col("mapped").isNotNull(), "fuzzy").otherwise("none").alias("how"))
    return hit.unionByName(found)


def relation_type(c) -> F.col:
    return F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit("_"))


def mapped(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends and a type, with the ends' titles (null if unmapped)."""
    r = relations.where("source <> '' and target <> '' and relation_type <> ''").withColumn("rel_type", relation_type(F.col("relation_type")))
    n = names.select("name", "mapped")
    return r.join(n.select(F.col("name").alias("source"), F.col("mapped").alias("s")), "source", "left").join(n.select(F.col("name").alias("target"), F.col("mapped").alias("t")), "target", "left")


def edges(of: DataFrame) -> DataFrame:
    return of.where("s is not null and t is not null and s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target"), "rel_type").agg(F.count("*").alias("count"))


def orphans(of: DataFrame) -> DataFrame:
    return of.where("s is null or t is null or s = t").select("chunk_id", "pos", "source", "target", "rel_type")


def type_distribution(counted: DataFrame) -> DataFrame:
    return counted.groupBy("rel_type").agg(F.sum("count").alias("n"), F.count("*").alias("edges"))
