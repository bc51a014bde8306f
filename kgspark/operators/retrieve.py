"""Batch retrieval: seeds, expansion, cap, order, resources, examples, chains, and the context text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.operators import graphqueries as gq
from kgspark.operators import traverse


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    resources: DataFrame
    explains: DataFrame
    examples: DataFrame
    exemplifies: DataFrame


def union_seeds(explicit: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, title, rank): explicit titles in order, then semantic ones not among them."""
    rows = explicit.select("query_id", "title", F.struct(F.lit(0).alias("s"), F.col("rank").cast("int").alias("r")).alias("at")).union(semantic.select("query_id", "title", F.struct(F.lit(1), F.col("rank").cast("int"))))
    once = rows.groupBy("query_id", "title").agg(F.min("at").alias("at"))
    return once.select("query_id", "title", F.row_number().over(W.partitionBy("query_id").orderBy("at", "title")).alias("rank"))


def expand(seeds: DataFrame, graph: Graph, prereq_depth: int = 2, related_depth: int = 1, max_concepts: int = 15) -> DataFrame:
    """(query_id, title, definition, difficulty, depth, relation, seed, pos): seeds, prerequisites and related concepts, each title at its least depth, at the place where it came first, the first max_concepts by (depth, place)."""
    s = seeds.select("query_id", F.col("title").alias("seed"), "rank").join(graph.vertices.select(F.col("title").alias("seed")), "seed", "left_semi")
    about = graph.vertices.select("title", *gq.described())
    names = s.select("seed").distinct()
    pre = s.join(traverse.prerequisites(names, graph.edges, prereq_depth), "seed").select("query_id", "seed", "title", "depth", F.lit("prerequisite").alias("relation"), F.lit(1).alias("stage"), "rank")
    rel = s.join(traverse.related(names, graph.edges, related_depth), "seed").select("query_id", "seed", "title", F.lit(1).alias("depth"), "relation", F.lit(2).alias("stage"), "rank")
    own = s.select("query_id", "seed", F.col("seed").alias("title"), F.lit(0).alias("depth"), F.lit("seed").alias("relation"), F.lit(0).alias("stage"), "rank")
    rows = own.unionByName(pre).unionByName(rel)
    # the order in which they come: seeds; prerequisites by depth; related
    place = F.struct("stage", F.when(F.col("stage") == 1, F.col("depth")).otherwise(0).alias("d"), "rank", "title", "relation")
    best = rows.withColumn("place", place).groupBy("query_id", "title").agg(F.min_by(F.struct("depth", "relation", "seed"), F.struct("depth", "place")).alias("x"), F.min("place").alias("place"))
    w = W.partitionBy("query_id").orderBy("x.depth", "place")
    kept = best.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_concepts)
    return kept.join(about, "title").select("query_id", "title", "definition", "difficulty", "x.depth", "x.relation", "x.seed", "pos")


def chains(seeds: DataFrame, graph: Graph, depth: int = 2) -> DataFrame:
    """(query_id, rank, chain)."""
    found = traverse.longest_chain(seeds.select(F.col("title").alias("seed")), graph.edges, depth)
    return seeds.join(found, seeds.title == found.seed).select("query_id", "rank", "chain")


def summary(queries: DataFrame, concepts: DataFrame, resources: DataFrame, examples: DataFrame, order: DataFrame) -> DataFrame:
    """Counts for each query, and the first five titles of its order; queries without matches have zeros."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    first = order.where("place < 5").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "title"))).alias("xs")).select("query_id", F.array_join("xs.title", " | ").alias("first_titles"))
    out = queries.select("query_id")
    for df in (n(concepts, "concepts"), n(resources, "resources"), n(examples, "examples"), first):
        out = out.join(df, "query_id", "left")
    return out.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("concepts", "resources", "examples")], F.coalesce("first_titles", F.lit("")).alias("first_titles"))


def _lines(df: DataFrame, by: list[str], line: Column, name: str) -> DataFrame:
    return df.select("query_id", F.struct(*by, line.alias("line")).alias("x")).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]).alias(name))


def context(queries: DataFrame, concepts: DataFrame, order: DataFrame, resources: DataFrame, examples: DataFrame, chain: DataFrame) -> DataFrame:
    """(query_id, context): numbered concepts, examples, resources by type, learning paths; sections without rows are left out."""
    nl = F.lit("\n")
    c = concepts.join(order, ["query_id", "title"])
    head = F.concat(nl, F.lit("**"), (F.col("place") + 1).cast("string"), F.lit(". "), F.col("title"), F.lit("** ["), F.when(F.col("difficulty") != "", F.col("difficulty")).otherwise("unknown"), F.lit("]"))
    text = F.when(F.col("definition") != "", F.col("definition")).otherwise("(not defined)")
    note = F.when(F.col("relation") != "seed", F.concat(nl, F.lit("stands as "), F.col("relation"), F.lit(" to "), F.col("seed"))).otherwise("")
    s1 = _lines(c, ["place"], F.concat(head, nl, text, note), "c")
    e = examples.join(order.withColumnRenamed("title", "concept"), ["query_id", "concept"])
    source = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(nl, F.lit("  from "), F.col("source_url"))).otherwise("")
    line = F.concat(F.when(F.col("r") == 1, F.concat(nl, F.lit("#### "), F.col("concept"), nl)).otherwise(""), F.lit("- ["), F.col("example_type"), F.lit("] "), F.col("text"), source)
    s2 = _lines(e, ["place", "r"], line, "e")
    w = W.partitionBy("query_id", "type").orderBy("url")
    r = resources.withColumn("r", F.row_number().over(w)).where("r <= 5")
    line = F.concat(F.when(F.col("r") == 1, F.concat(nl, F.lit("#### "), F.col("type"), nl)).otherwise(""), F.lit("- "), F.col("url"), nl, F.lit("  on "), F.array_join(F.slice("concepts", 1, 3), ", "))
    s3 = _lines(r, ["type", "r"], line, "r")
    s4 = _lines(chain.where("size(chain) > 1"), ["rank"], F.concat(F.lit("- "), F.array_join("chain", " → ")), "p")
    out = queries.select("query_id").join(s1, "query_id", "left").join(s2, "query_id", "left").join(s3, "query_id", "left").join(s4, "query_id", "left")
    section = lambda title, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(title), nl, F.array_join(col, "\n")))
    first = F.concat(F.lit("### Concepts, basics first"), F.when(F.col("c").isNotNull(), F.concat(nl, F.array_join("c", "\n"))).otherwise(""))
    return out.select("query_id", F.concat_ws("\n", first, section("\n### Worked examples", "e"), section("\n### Where to read on", "r"), section("\n### Ways to get there", "p")).alias("context"))


def answer_prompt(rows: DataFrame) -> DataFrame:
    """rows (query_id, query, context) → the prompt for an answering model."""
    ask = "\n\n---\n\nExplain this thoroughly: why it matters, what must be understood first, the topic itself with the examples above, which of the resources to read, and what to learn next."
    return rows.select("query_id", F.concat(F.lit("## Question\n"), F.col("query"), F.lit("\n\n## Knowledge graph context\n"), F.col("context"), F.lit(ask)).alias("prompt"))


def math_delimiters(text: Column) -> Column:
    """\\[..\\] to $$..$$ and \\(..\\) to $..$, across lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$"), r"(?s)\\\((.*?)\\\)", r"\$$1\$")
