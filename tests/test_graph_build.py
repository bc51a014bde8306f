"""The kept table of mentions gives the rows of the views' texts; facts give what all mentions give."""

import os
import re
import tracemalloc
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgspark.functions.fuzzy import similar_pairs
from kgspark.operators import concepts as C
from kgspark.operators import extract as E
from kgspark.operators import graphqueries as Q
from kgspark.operators import pages as P
from kgspark.operators import traverse as T
from kgspark.operators import vectors as V
from kgspark.plans.build import graph_of
from kgspark.sources import io
from kgspark.sources.checkpoints import shared_folder
from kgspark.sources.views import graph_views, view


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_views_of_one_table_equal_their_texts(spark, tmp_path):
    at = datetime(2024, 1, 1)
    # a line twice, lines without a part, without a key or with a part that is there twice
    lines = [(k, p, s, n, float(q), 1.0, 0.0, 0.0, f, "O", at) for k, p, s, n, q, f in [
        (1, 1, 3, 1, 45, "R"), (1, 2, 4, 2, 3, "A"), (1, 2, 4, 2, 3, "A"), (1, 9, 5, 3, 50, "N"), (1, 3, 6, 4, 50, "R"), (1, 1, 7, 5, 41, "R"),
        (2, None, 8, 1, 60, "R"), (2, 1, 8, 2, 60, "R"), (2, 3, None, 3, 60, "A"), (None, 1, 1, 1, 60, "R"), (None, 2, 1, 2, 60, "R"), (3, 3, 2, 1, 1, "N"),
    ]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "hot bolt", "Brand#1", "SMALL", 10), (2, "red ring", "Brand#2", "LARGE", 40), (3, "oak", "Brand#3", "MEDIUM", 50), (3, "elm", None, "MEDIUM", 20)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    kept = []
    got = graph_views(spark, str(tmp_path), lambda df: kept.append(df) or df)
    assert len(kept) == 1
    for name in ("v_mention", "v_relation", "v_example"):
        want = view(spark, str(tmp_path), name)
        assert got[name].columns == want.columns and sum(rows(want).values()) > 3
        assert rows(got[name]) == rows(want), name


def test_facts_count_mentions_that_say_the_same(spark):
    said = [("2", 1, "u1", "Graphs", "short", "beginner", "G"), ("10", 3, "u2", "Graphs", "short", "beginner", "G"), ("10", 2, "u2", "Graphs", "short", "beginner", "G"),
            ("3", 1, "u1", "graph", "the longer one", "advanced", "g"), ("3", 2, "u3", "graph", "the other one.", None, None), ("4", 1, None, "", "none", None, None), ("5", 1, "u1", None, None, None, None)]
    m = spark.createDataFrame(said, "chunk_id string, pos int, source_url string, title string, definition string, difficulty string, alias string")
    f = C.facts(m)
    assert sorted((r.title, r.definition, r.n, tuple(r.ord)) for r in f.collect()) == [("Graphs", "short", 3, ("10", 2)), ("graph", "the longer one", 1, ("3", 1)), ("graph", "the other one.", 1, ("3", 2))]
    lead = C.exact_leaders(C.title_groups(C.normalized(f)))
    assert [(r.norm, r.mentions, tuple(r.first_seen)) for r in C.title_groups(C.normalized(f)).collect()] == [("graph", 5, ("10", 2))]
    c = C.canonical(m, lead).first()
    assert (c.title, c.definition, c.difficulty, c.mention_count, c.chunk_count, c.aliases, c.source_urls) == ("Graphs", "the longer one", "beginner", 5, 3, ["G", "g", "graph"], ["u1", "u2", "u3"])
    narrow = C.canonical(m, lead, sources=False, chunks=False, counted=f)
    assert {(r.leader, r.url) for r in C.sources_of(m, C.leaders_of_titles(f, lead)).collect()} == {("graph", "u1"), ("graph", "u2"), ("graph", "u3")} == {(r.leader, r.url) for r in C.sources_of(m, lead).collect()}
    assert C.with_chunk_counts(narrow, m, C.leaders_of_titles(f, lead)).first().chunk_count == 3
    by_facts, by_mentions = C.name_map(narrow, f, lead), C.name_map(narrow, m, lead)
    assert rows(by_facts.withColumn("first_place", F.to_json("first_place"))) == rows(by_mentions.withColumn("first_place", F.to_json("first_place")))


def test_runs_of_words_are_not_broadcast(spark):
    chunks = spark.createDataFrame([(1, "A hot bolt and a bolt"), (2, "nothing")], "chunk_id int, text string")
    names = spark.createDataFrame([("Hot Bolt", "Hot Bolt"), ("bolt", "Bolt"), ("nut", "Nut")], "name string, title string")
    got = E.tag(chunks, names)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert rows(got) == {(1, "Hot Bolt"): 1, (1, "Bolt"): 1}


def test_the_longest_paths_are_not_written(spark):
    base = shared_folder(spark)
    edges = spark.createDataFrame([(a, b, "PREREQ_OF") for a, b in ["ab", "bc", "cd", "bd", "da"]], "source string, target string, rel_type string")
    before = set(os.listdir(base))
    got = T.paths_into(spark.createDataFrame([("d",)], "seed string"), edges, 3)
    assert sum(n.startswith("paths-") for n in set(os.listdir(base)) - before) == 2
    assert {"".join(r.path) for r in got.collect()} == {"cd", "bd", "bcd", "abd", "abcd", "dabd"}


def test_paths_cost_a_comparison_a_row_and_are_dealt_to_all_tasks(spark):
    pairs = [(a, b) for a in "abcdef" for b in "abcdef" if (ord(a) * 7 + ord(b) * 3) % 5 < 2]
    edges = spark.createDataFrame([(a, b, "PREREQ_OF") for a, b in pairs], "source string, target string, rel_type string")
    ways, done = [[(a, b)] for a, b in pairs if b == "c"], []
    for _ in range(4):
        done += ways
        ways = [[e, *w] for w in ways for e in pairs if e[1] == w[0][0] and e not in w]
    got = T.paths_into(spark.createDataFrame([("c",)], "seed string"), edges, 4)
    texts = got.select("text", "steps")
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" not in plan and "transform(" not in plan
    # three reads of shorter paths and the last step
    assert texts.rdd.getNumPartitions() >= 3 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(texts) == {(" > ".join([w[0][0], *(e[1] for e in w)]), len(w)): 1 for w in done} and any(a == b for a, b in pairs)
    assert {" > ".join(r.path) for r in got.collect()} == {r.text for r in texts.collect()}


def test_similar_pairs_are_verified_by_many_tasks(spark):
    words = spark.createDataFrame([(f"large ring {i}",) for i in range(30)], "title string")
    pairs = similar_pairs(words, None, 80.0, False)
    pairs.collect()
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_exported_lines_are_compressed_and_nodes_stand_alone(spark, tmp_path):
    nodes = spark.createDataFrame([(["Concept"], ("A",), 1), (["Concept"], ("B",), 1)], "labels array<string>, properties struct<title:string>, ord int")
    nodes = nodes.select("labels", F.from_json(F.to_json("properties"), "struct<" + io.NODE.replace(" ", ":").replace(",:", ",") + ">").alias("properties"), "ord")
    io.write_graph(nodes.drop("ord"), None, str(tmp_path / "g"))
    files = [n for n in os.listdir(tmp_path / "g" / "nodes") if n.startswith("part-")]
    assert files and all(n.endswith(".json.gz") for n in files) and not os.path.exists(tmp_path / "g" / "relationships")
    back = io.read_nodes(spark, str(tmp_path / "g"))
    late = back.withColumn("properties", F.col("properties").withField("definition", F.lit("new"))).withColumn("ord", F.lit(2))
    got = io.import_nodes(back.withColumn("ord", F.lit(1)).unionByName(late), "ord")
    assert {(r.label, r.key, r.properties.definition) for r in got.collect()} == {("Concept", "A", "new"), ("Concept", "B", "new")}


def test_explicit_seeds_stand_beside_all_semantic_ones(spark):
    most = entry.queries()["h02_explicit_seeds"](spark, "/root/testdata/sf0.001").groupBy("query_id").count().agg(F.max("count")).first()[0]
    near = entry.queries()["v04_vector_search"](spark, "/root/testdata/sf0.001").groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert near == 5 and most > 5


def test_distances_of_a_batch_are_not_held_for_all_queries():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(2000, 16)), rng.normal(size=(2000, 16))
    batch = pd.DataFrame({"id": range(2000), "embedding": list(v)})
    tracemalloc.start()
    got = {int(x["query_id"].iloc[0]): list(x["id"]) for x in V.nearest(iter([batch]), list(range(2000)), q, 3, cells=1 << 16)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all distances together are 32 MB
    for i in (0, 31, 32, 33, 1999):
        assert got[i] == list(np.argsort(((v - q[i]) ** 2).sum(1), kind="stable")[:3])


def test_pages_are_parsed_a_few_at_once():
    pages = pd.DataFrame({"url": [f"u{i}" for i in range(300)], "html": [f"<title>{i}</title><a href='/{i}'>x</a>" for i in range(300)]})
    parts = list(P.parsed_rows(iter([pages, pages.iloc[:0]])))
    assert max(map(len, parts)) <= 128 and list(pd.concat(parts)["title"]) == [str(i) for i in range(300)]


def test_vertices_are_made_without_relations_and_sources(spark, tmp_path):
    d = str(tmp_path / "tables")
    os.mkdir(d)
    for name in ("lineitem", "part"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", f"{d}/{name}.parquet")
    base = shared_folder(spark)
    before = set(os.listdir(base))
    made = lambda: {n.split("-")[0] for n in set(os.listdir(base)) - before}
    g = graph_of(spark, d)
    assert g.vertices.count() > 0 and made() & {"relations", "sources", "mapped"} == set()
    assert g.edges.count() > 0 and "relations" in made() and "sources" not in made()
    assert g.explains.count() > 0 and "sources" in made() and graph_of(spark, d) is g


def test_facts_are_sorted_by_a_number_first(spark):
    said = [("1", 1, "A", "x", None, "a"), ("1", 2, "A", "x", None, "a"), ("1", 3, None, "x", None, "a"), ("2", 1, "A", "x", None, None)]
    f = C.facts(spark.createDataFrame(said, "chunk_id string, pos int, title string, definition string, difficulty string, alias string"))
    assert f.columns == ["title", "definition", "difficulty", "aliases", "n", "ord"] and sorted((r.n, tuple(r.ord)) for r in f.collect()) == [(1, ("2", 1)), (2, ("1", 1))]
    sorts = [line for line in f._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortAggregate(key=" in line]
    assert sorts and all("SortAggregate(key=[_hash#" in line for line in sorts)


def test_only_edges_of_the_concepts_asked_for_are_shuffled(spark):
    c = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B")], "query_id long, title string")
    explains = spark.createDataFrame([("u", "A"), ("u", "A"), ("u", "B"), ("v", "B"), ("w", "C")], "url string, concept string")
    kinds = spark.createDataFrame([("u", "pdf"), ("v", "web"), ("w", "web")], "url string, type string")
    got = Q.resources_of(c, explains, kinds)
    assert {(r.query_id, r.url, r.type, tuple(r.concepts)) for r in got.collect()} == {(1, "u", "pdf", ("A", "B")), (1, "v", "web", ("B",)), (2, "u", "pdf", ("B",)), (2, "v", "web", ("B",))}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # of concepts, and of resources


def test_prerequisites_and_orders_drop_edges_that_are_there_twice(spark):
    e = spark.createDataFrame([(a, b, "PREREQ_OF") for a, b in ["ab", "ab", "bc", "bc", "ca"]], "source string, target string, rel_type string")
    got = T.prerequisites(spark.createDataFrame([("c",)], "seed string"), e, 3)
    assert rows(got) == {("c", "b", 1): 1, ("c", "a", 2): 1, ("c", "c", 3): 1}
    c = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "d", 2)], "query_id long, title string, pos int")
    assert [r.title for r in T.kahn_orders(c, e).orderBy("place").collect()] == ["a", "d", "b"]
    for df in (T.prerequisites(spark.createDataFrame([("c",)], "seed string"), e, 1), T.kahn_orders(c, e)):  # not all edges are shuffled
        assert not re.search(r"Aggregate \[source#\d+, target#\d+\]", df._jdf.queryExecution().optimizedPlan().toString())


def test_retrieved_concepts_are_made_once(spark):
    base = shared_folder(spark)
    before = set(os.listdir(base))
    assert entry.queries()["h03_result_summary"](spark, "/root/testdata/sf0.001").count() > 0
    assert sum(n.startswith("retrieved-") for n in set(os.listdir(base)) - before) == 1
