"""Questions put to the concept graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(vertices: DataFrame, text: str) -> DataFrame:
    """Vertices whose title or an alias contains text, without case."""
    low = F.lit(text.lower())
    return vertices.where(F.contains(F.lower("title"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low)))


def search(vertices: DataFrame, text: str, k: int = 10) -> DataFrame:
    return matches(vertices, text).select("title", "difficulty", "mention_count").orderBy(F.desc("mention_count"), "title").limit(k)


def subtypes(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    parents = matches(vertices, text).select(F.col("title").alias("target"))
    found = edges.where("rel_type = 'IS_A'").join(parents, "target").select(F.col("source").alias("title"), F.col("target").alias("parent"))
    return found.join(vertices.select("title", "mention_count"), "title").select("title", "parent", "mention_count")


def prerequisites_of(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    m = matches(vertices, text).select("title")
    parts = edges.where("rel_type in ('IS_A', 'PART_OF')").join(m.select(F.col("title").alias("target")), "target").select(F.col("source").alias("title"))
    targets = m.union(parts).distinct().select(F.col("title").alias("target"))
    return edges.where("rel_type = 'PREREQ_OF'").join(targets, "target").select(F.col("source").alias("title")).distinct()


def most_connected(vertices: DataFrame, edges: DataFrame, explains: DataFrame, exemplifies: DataFrame | None = None, k: int = 15) -> DataFrame:
    """Undirected degree over all edge types, zero included; ends are counted before the shuffle."""
    ends = edges.select(F.col("source").alias("title")).union(edges.select("target")).union(explains.select("concept"))
    if exemplifies is not None:
        ends = ends.union(exemplifies.select("concept"))
    degree = ends.groupBy("title").agg(F.count("*").alias("n"))
    return vertices.select("title").join(degree, "title", "left").select("title", F.coalesce("n", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "title").limit(k)


def resources_explaining(vertices: DataFrame, explains: DataFrame, resources: DataFrame, text: str, k: int = 10) -> DataFrame:
    m = matches(vertices, text).select(F.col("title").alias("concept"))
    return explains.join(m, "concept").join(resources, "url").select("url", "type", "concept").orderBy("url", "concept").limit(k)


def neighbourhood(vertices: DataFrame, edges: DataFrame, title: str, max_nodes: int = 15) -> DataFrame:
    own = vertices.where(F.lower("title") == title.lower()).select(F.col("title").alias("own"))
    out = edges.join(own, F.col("source") == F.col("own")).select(F.col("target").alias("neighbour"), "rel_type", F.lit("out").alias("direction"))
    into = edges.join(own, F.col("target") == F.col("own")).select(F.col("source").alias("neighbour"), "rel_type", F.lit("in").alias("direction"))
    return out.union(into).orderBy("neighbour", "rel_type", "direction").limit(2 * max_nodes)


def suggestions(vertices: DataFrame, title: str, k: int = 5) -> DataFrame:
    return vertices.where(F.contains(F.lower("title"), F.lit(title.lower().split()[0]))).select("title").orderBy("title").limit(k)


def seed_rows(seeds: DataFrame, vertices: DataFrame) -> DataFrame:
    """seeds (query_id, title, rank) → found ones as retrieved concepts of depth 0."""
    return seeds.join(vertices.select("title", "definition", "difficulty"), "title").select("query_id", "title", *described(), F.lit(0).alias("depth"), F.lit("seed").alias("relation"), F.col("title").alias("seed"), F.lit(0).alias("stage"), F.col("rank").cast("long").alias("srank"))


def described() -> list[Column]:
    return [F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")]


def resources_of(concepts: DataFrame, explains: DataFrame, resources: DataFrame) -> DataFrame:
    """(query_id, url, type, concepts): resources of a query's concepts, with those of its concepts that each explains.

    Only edges of the concepts asked for are shuffled; edges that are there twice count once.
    """
    c = concepts.select("query_id", F.col("title").alias("concept")).distinct()
    return c.join(explains, "concept").groupBy("query_id", "url").agg(F.sort_array(F.collect_set("concept")).alias("concepts")).join(resources, "url").select("query_id", "url", "type", "concepts")


def examples_of(concepts: DataFrame, examples: DataFrame, links: DataFrame, n: int = 2) -> DataFrame:
    """The first n examples of each concept of a query, by type, then id."""
    from pyspark.sql import Window as W

    kept = links.join(examples.drop("concept"), "example_id")
    w = W.partitionBy("concept").orderBy("example_type", "example_id")
    first = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return concepts.select("query_id", F.col("title").alias("concept")).distinct().join(first, "concept").select("query_id", "concept", "example_id", "example_type", "text", "source_url", "r")
