"""Vertices and edges of the concept graph, examples, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.urls import resource_type


def concept_vertices(concepts: DataFrame) -> DataFrame:
    return concepts.select("title", "definition", "difficulty", "aliases", "mention_count").dropDuplicates(["title"])


def resource_vertices(sources: DataFrame) -> DataFrame:
    """(url, type) of sources (leader, url)."""
    return sources.select("url").distinct().select("url", resource_type(F.col("url")).alias("type"))


def resources_by_type(resources: DataFrame) -> DataFrame:
    return resources.groupBy("type").agg(F.count("*").alias("resources"))


def explains_edges(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, concept): sources (leader, url), each once, under their concept's title; a concept's sources stay rows.

    A title is one leader's, as each raw title has one norm: pairs are distinct as they are.
    """
    return sources.join(concepts.select("leader", "title"), "leader").select("url", F.col("title").alias("concept"))


def concept_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select("title")
    return edges.join(v.select(F.col("title").alias("source")), "source", "left_semi").join(v.select(F.col("title").alias("target")), "target", "left_semi").select("source", "target", "rel_type", "count")


def examples(rows: DataFrame) -> DataFrame:
    """Examples with text and concept, each with its id; the first by (chunk_id, pos) of an id stays."""
    named = rows.where("text <> '' and concept <> ''").select(
        F.substring(F.md5(F.concat_ws(":", "text", "concept")), 1, 16).alias("example_id"), "text", "concept", F.coalesce(F.when(F.col("example_type") != "", F.col("example_type")), F.lit("unknown")).alias("example_type"), "chunk_id", "source_url", "pos"
    )
    first = F.min_by(F.struct("text", "concept", "example_type", "chunk_id", "source_url"), F.struct("chunk_id", "pos")).alias("x")
    return named.groupBy("example_id").agg(first).select("example_id", "x.*")


def exemplifies(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """(example_id, concept): the example's concept is a title or an alias, without case and spaces at the ends."""
    names = vertices.select("title", F.explode(F.concat(F.array("title"), "aliases")).alias("name")).select("title", F.lower(F.trim("name")).alias("key")).distinct()
    return found.select("example_id", F.lower(F.trim("concept")).alias("key")).join(names, "key").select("example_id", F.col("title").alias("concept")).distinct()


def unlinked(found: DataFrame, links: DataFrame, k: int = 20) -> DataFrame:
    return found.join(links.select("example_id").distinct(), "example_id", "left_anti").groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(k)


def examples_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("example_type").agg(F.count("*").alias("n"))


def write_back(extractions: DataFrame, rows: DataFrame) -> DataFrame:
    """Extractions with the examples of their chunk, in order."""
    per = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "concept", "example_type"))).alias("examples"))
    return extractions.drop("examples").join(per, "chunk_id", "left").withColumn("examples", F.coalesce("examples", F.array().cast(per.schema["examples"].dataType)))


def summary(vertices: DataFrame, resources: DataFrame, found: DataFrame, edges: DataFrame, explains: DataFrame, links: DataFrame) -> DataFrame:
    count = lambda df, kind, name: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
    return (
        count(vertices, "vertex", "Concept").union(count(resources, "vertex", "Resource")).union(count(found, "vertex", "Example"))
        .union(edges.groupBy("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge"), "rel_type", "n"))
        .union(count(explains, "edge", "EXPLAINS")).union(count(links, "edge", "EXEMPLIFIES"))
    )
