"""The knowledge-graph job: mentions and relations to vertices and edges."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import concepts as C
from kgspark.operators import graph as G
from kgspark.operators import relations as R
from kgspark.operators.retrieve import Graph
from kgspark.sources.checkpoints import stored
from kgspark.sources.views import graph_views


class Parts:
    """The parts of the graph under the names that Graph gives them; each is made and kept once it is asked for.

    fuzzy merges similar titles and maps similar names; without it titles group
    by their normal form. What reads vertices alone thus makes neither relations
    nor sources, and what walks over edges no examples.
    """

    def __init__(self, mentions: DataFrame, relations: DataFrame, examples: DataFrame, fuzzy: bool = False) -> None:
        self.given, self.fuzzy = (mentions, relations, examples), fuzzy

    @cached_property
    def counted(self) -> DataFrame:
        return stored(C.facts(self.given[0]), "facts")

    @cached_property
    def leader_of(self) -> DataFrame:
        return stored(C.merge_similar(self.counted) if self.fuzzy else C.exact_leaders(C.title_groups(C.normalized(self.counted))), "leaders")

    @cached_property
    def core(self) -> DataFrame:
        return stored(C.canonical(self.given[0], self.leader_of, sources=False, chunks=False, counted=self.counted), "concepts")

    @cached_property
    def titles(self) -> DataFrame:
        return stored(C.leaders_of_titles(self.counted, self.leader_of), "titles")

    @cached_property
    def sources(self) -> DataFrame:
        return stored(C.sources_of(self.given[0], self.titles), "sources")

    @cached_property
    def vertices(self) -> DataFrame:
        return stored(G.concept_vertices(self.core), "graph")

    @cached_property
    def edges(self) -> DataFrame:
        # relations may be a long plan: their ends, and their counts, read the kept rows
        relations = stored(self.given[1].select("source", "target", "relation_type"), "relations")
        ends = relations.select("source").union(relations.select("target")).toDF("name").distinct()
        names = stored(R.map_names(ends, stored(C.name_map(self.core, self.counted, self.leader_of), "names"), self.fuzzy), "mapped")
        return stored(G.concept_edges(R.edges(R.mapped(relations, names)), self.vertices), "graph")

    @cached_property
    def resources(self) -> DataFrame:
        return stored(G.resource_vertices(self.sources), "graph")

    @cached_property
    def explains(self) -> DataFrame:
        return stored(G.explains_edges(self.core, self.sources), "graph")

    @cached_property
    def examples(self) -> DataFrame:
        return stored(G.examples(self.given[2]), "graph")

    @cached_property
    def exemplifies(self) -> DataFrame:
        return stored(G.exemplifies(self.examples, self.vertices), "graph")


def build(mentions: DataFrame, relations: DataFrame, examples: DataFrame, fuzzy: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, canonical concepts), all parts of it made."""
    p = Parts(mentions, relations, examples, fuzzy)
    concepts = C.with_chunk_counts(p.core, mentions, p.titles)
    return Graph(p.vertices, p.edges, p.resources, p.explains, p.examples, p.exemplifies), concepts


def read_once(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views of the graph over one table of mentions, written once."""
    return graph_views(spark, sf_dir, lambda df: stored(df, "mentions"))


def state_of(spark: SparkSession, folder: str) -> int | None:
    """A number that changes with names, times and lengths of a folder's files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("n")).first().n


_BUILT: dict[tuple, tuple[int | None, Parts]] = {}


def graph_of(spark: SparkSession, sf_dir: str, fuzzy: bool = False) -> Parts:
    """The graph of the test tables' mentions, its parts kept in the checkpoint folder and built again once the tables' files have changed; with fuzzy, of merged similar titles."""
    key, state = (spark.sparkContext.applicationId, sf_dir, fuzzy), state_of(spark, sf_dir)
    if key not in _BUILT or _BUILT[key][0] != state:
        given = read_once(spark, sf_dir)
        _BUILT[key] = state, Parts(given["v_mention"], given["v_relation"], given["v_example"], fuzzy)
    return _BUILT[key][1]
