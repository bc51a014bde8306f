import json
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.fuzzy import normalize_title, ratio, similar_pairs
from kgspark.operators import concepts as C
from kgspark.operators import extract as E
from kgspark.operators import graph as G
from kgspark.operators import relations as R
from kgspark.operators import traverse as T
from kgspark.plans.build import build, state_of
from kgspark.operators import resources as RS
from kgspark.sources import io
from kgspark.sources.tables import KeyedTable


def test_crawl_equals_plain_search(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 40), (60, 150)):
        links = [(f"u{rng.randrange(n)}", f"u{rng.randrange(n + 5)}") for _ in range(m)] + [("u0", None)]
        fetched = {f"u{i}" for i in range(n) if i % 4}
        fetched |= {"u0"}
        depth, front = {"u0": 0}, ["u0"]
        while front:
            front = [b for b in dict.fromkeys(b for a, b in links if a in front and a in fetched and b) if b not in depth and not depth.update({b: max(depth[a] for a in front) + 1})]
        got = T.crawl(spark.createDataFrame([("u0",), ("u0",), (None,)], "url string"), spark.createDataFrame(links * 2, "url string, link string"), spark.createDataFrame([(x,) for x in fetched], "url string"))
        assert sorted(tuple(r) for r in got.collect()) == sorted((u, d, u in fetched) for u, d in depth.items())
    none = spark.createDataFrame([], "url string")
    assert T.crawl(none, spark.createDataFrame(links, "url string, link string"), none).count() == 0


def test_crawl_does_not_shuffle_its_store(spark):
    got = T.crawl(spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "url string, link string"), spark.createDataFrame([("a",), ("b",)], "url string"), most=1)
    assert {tuple(r) for r in got.collect()} == {("a", 0, True), ("b", 1, True)}
    met = spark.createDataFrame([("z",)], "url string").distinct()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = met.join(got.select("url"), "url", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan


def test_siblings_are_all_pairs(spark):
    tagged = [(c, f"t{i:03}") for c, n in ((1, 1), (2, 2), (3, 150)) for i in range(n)] + [(2, "t000")]
    got = E.siblings(spark.createDataFrame(tagged, "chunk_id long, title string"), block=8).collect()
    want = {(c, f"t{i:03}", f"t{j:03}") for c, n in ((2, 2), (3, 150)) for j in range(n) for i in range(j)}
    assert len(got) == len(want) and {(r.chunk_id, r.source, r.target) for r in got} == want and {r.relation_type for r in got} == {"sibling"}


def test_tagger_finds_names_anywhere(spark):
    chunks = spark.createDataFrame([(1, "A red bolt, the Blue gear and one very long name here; red"), (2, ""), (3, None)], "chunk_id long, text string")
    names = spark.createDataFrame([("Red bolt", "R"), ("red bolt", "R"), ("blue gear", "B"), ("red", "red"), ("very long name here", "L"), ("gear one", "no"), ("one very long name here", "five words")], "name string, title string")
    assert sorted(tuple(r) for r in E.tag(chunks, names).collect()) == [(1, "B"), (1, "L"), (1, "R"), (1, "red")]


def titles(n, seed=5):
    rng = random.Random(seed)
    words = ["gradient", "descent", "linear", "map", "graph", "neural", "network", "tree", "search", "the"]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice("abcxyz s") + t[i + rng.randint(0, 1) :]
        out.append(t.strip() or "x")
    return sorted(set(out)) + ["a", "ab", "abc", "é"]


@pytest.mark.parametrize("block", [3, 1024])
def test_similar_pairs_lose_none(spark, block):
    ts = titles(250)
    df = spark.createDataFrame([(t,) for t in ts], "title string")
    got = similar_pairs(df, None, 87.5, False, 10, block=block).collect()
    want = {(a, b) for a in ts for b in ts if a < b and abs(len(a) - len(b)) <= 10 and ratio(a, b) >= 87.5}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    some = ts[::7]
    got = similar_pairs(spark.createDataFrame([(t,) for t in some], "title string"), df, 84.5, True, block=block).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in some for b in ts if ratio(a, b) > 84.5}


def test_graph_of_merged_titles_equals_greedy_merge(spark):
    ts = titles(120, 9)
    rng = random.Random(1)
    mentions = [(f"{i:03}", 0, f"http://x/{i % 9}", rng.choice(ts), f"about {i}", rng.choice(["beginner", "advanced", None]), None) for i in range(300)]
    relations = [(f"{i:03}", 1, rng.choice(ts), rng.choice(ts) + rng.choice(["", "z"]), "is-a") for i in range(200)]
    examples = [(f"{i:03}", 0, f"http://x/{i}", f"example {i}", rng.choice(ts).upper(), "code") for i in range(40)]
    m = spark.createDataFrame(mentions, "chunk_id string, pos int, source_url string, title string, definition string, difficulty string, alias string")
    r = spark.createDataFrame(relations, "chunk_id string, pos int, source string, target string, relation_type string")
    x = spark.createDataFrame(examples, "chunk_id string, pos int, source_url string, text string, concept string, example_type string")
    norm = {q.title: q.norm for q in spark.createDataFrame([(t,) for t in {a[3] for a in mentions}], "title string").select("title", normalize_title(F.col("title")).alias("norm")).collect()}
    order = list(dict.fromkeys(norm[a[3]] for a in mentions))
    leader = {}
    for i, a in enumerate(order):
        if a not in leader:
            leader[a] = a
            for b in order[i + 1 :]:
                if b not in leader and abs(len(a) - len(b)) <= 10 and ratio(a, b) >= 87.5:
                    leader[b] = a
    assert {q.norm: q.leader for q in C.merge_similar(m).collect()} == leader
    graph, concepts = build(m, r, x, fuzzy=True)
    counts = {}
    for a in mentions:
        counts[leader[norm[a[3]]]] = counts.get(leader[norm[a[3]]], 0) + 1
    assert {q.leader: q.mention_count for q in concepts.collect()} == counts
    # every edge end and its count against a plain lookup
    mapping = C.name_map(concepts, m, C.merge_similar(m))
    keys = [(q.name, q.title) for q in mapping.orderBy("first_place").collect()]
    known = dict(keys)
    low = {q.n: q.norm for q in spark.createDataFrame([(t,) for t in {e for a in relations for e in a[2:4]}], "n string").select("n", normalize_title(F.col("n")).alias("norm")).collect()}

    def find(name):
        for k in (name.lower().strip(), low[name]):
            if k in known:
                return known[k]
        best = max(((round(ratio(low[name], k)), -i) for i, (k, _) in enumerate(keys)), default=(0, 0))
        return keys[-best[1]][1] if best[0] >= 85 else None

    want = {}
    for a in relations:
        s, t = find(a[2]), find(a[3])
        if s and t and s != t:
            want[s, t] = want.get((s, t), 0) + 1
    assert {(q.source, q.target): q["count"] for q in graph.edges.collect()} == want
    assert R.orphans(R.mapped(r, R.map_names(r.select("source").union(r.select("target")).toDF("name"), mapping))).count() == sum(1 for a in relations if not find(a[2]) or not find(a[3]) or find(a[2]) == find(a[3]))


def test_snapshot_tells_damage(spark, tmp_path):
    rows = [(1, "a", [1.5, None], {"k": 1}), (2, None, None, None), (2, None, None, None)]
    a = spark.createDataFrame(rows, "id long, t string, xs array<double>, m map<string, int>")
    path = str(tmp_path / "snap")
    manifest = io.snapshot({"a": a, "b": a.limit(0)}, path)
    got = {r.name: r for r in manifest.collect()}
    assert (got["a"].rows, got["a"].columns, got["b"].rows, got["b"].checksum) == (3, 4, 0, "0") and got["a"].taken_at is not None
    assert io.damaged(spark, path).count() == 0 and sorted(map(str, io.restore(spark, path)["a"].collect())) == sorted(map(str, a.collect()))
    # another order is no damage; a changed value, a row twice and a lost row are
    a.repartition(3).write.mode("overwrite").parquet(f"{path}/a")
    assert io.damaged(spark, path).count() == 0
    for other in (a.withColumn("t", F.coalesce("t", F.lit(""))), a.union(a.limit(1)), a.where("id = 1")):
        other.write.mode("overwrite").parquet(f"{path}/a")
        assert [r.name for r in io.damaged(spark, path).collect()] == ["a"]
        with pytest.raises(ValueError, match="damaged: a"):
            io.restore(spark, path)


def files(path):
    return {str(f): f.read_bytes() for f in path.rglob("*.parquet")}


def test_keyed_table_equals_plain_dict(spark, tmp_path):
    rng = random.Random(8)
    table = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=8)
    want = {i: {"x": f"b{i}", "kept": i * 10, "n": None} for i in range(60)} | {None: {"x": None, "kept": 1, "n": None}}
    table.create(spark.createDataFrame([(k, r["x"], r["kept"]) for k, r in want.items()], "k int, x string, kept int"))
    schemas = {"x": "string", "n": "map<string, int>"}
    for turn in range(4):
        names = [["x"], ["n"], ["x", "n"], ["x"]][turn]
        keys = [rng.choice([None, *range(70)]) for _ in range(12)]
        rows = [(k, v, *[None if rng.random() < 0.3 else f"{turn}-{v}" if c == "x" else {"a": v} for c in names]) for v, k in enumerate(keys)]
        for k, _, *values in rows:
            want.setdefault(k, {"x": None, "kept": None, "n": None}).update(zip(names, values))
        table.put(spark.createDataFrame(rows, "k int, v int, " + ", ".join(f"{c} {schemas[c]}" for c in names)), "v")
        if turn == 1:
            before = files(tmp_path)
            touched = table.compact()
            assert touched and table.compact() == [] and files(tmp_path).items() >= before.items()
        if turn:
            got = {r.k: {c: r[c] for c in ("x", "kept", "n")} for r in table.read().collect()}
            assert got == want
    # a put and a compaction that were cut short change nothing; an empty put neither
    (tmp_path / "t" / "delta=000000090").mkdir()
    (tmp_path / "t" / "where=000000091").mkdir()
    table.put(spark.createDataFrame([], "k int, v int, x string"), "v")
    assert {r.k: r.x for r in table.read().collect()} == {k: r["x"] for k, r in want.items()}
    # one touched bucket: the others' rows lie where they lay
    table.compact()
    where = table._where()
    table.put(spark.createDataFrame([(3, 1, "last")], "k int, v int, x string"), "v")
    (bucket,) = table.compact()
    assert {b: v for b, v in table._where().items() if b != bucket} == {b: v for b, v in where.items() if b != bucket}
    assert table.read().where("k = 3").first().x == "last" and table.read().count() == len(want)
    empty = KeyedTable(spark, str(tmp_path / "e"), "k", buckets=4)
    empty.create(spark.createDataFrame([], "k int, x string"))
    assert empty.read().count() == 0
    empty.put(spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k int, v int, x string"), "v")
    assert [tuple(r) for r in empty.read().collect()] == [(1, "b")]


def test_results_turn_pending_resources(spark):
    r = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "ingested"), ("d", "pending")], "url string, status string").withColumn("local_path", F.lit("old"))
    results = spark.createDataFrame([("a", True, "pa", {"pages": 3}), ("b", False, "pb", None), ("c", True, "pc", None)], "url string, ok boolean, local_path string, metadata map<string, int>")
    got = {x.url: (x.status, x.local_path, x.metadata) for x in RS.apply_results(r, results).collect()}
    assert got == {"a": ("ingested", "pa", {"pages": 3}), "b": ("failed", "old", None), "c": ("ingested", "old", None), "d": ("pending", "old", None)}
    assert {x.url: x.status for x in RS.apply_results(r, results.select("url", "ok")).collect()}["a"] == "ingested"


def test_graph_export_and_import(spark, tmp_path):
    v = spark.createDataFrame([("A", "about", "beginner", ["a", "é"], 3), ("B", None, None, [], 1)], "title string, definition string, difficulty string, aliases array<string>, mention_count long")
    r = spark.createDataFrame([("http://x", "web")], "url string, type string")
    x = spark.createDataFrame([("http://x", "A"), ("http://gone", "A")], "url string, concept string")
    e = spark.createDataFrame([("A", "B", "is-a", 2)], "source string, target string, rel_type string, count long")
    path = str(tmp_path / "g")
    io.write_graph(*io.graph_export(v, r, x, e), path)
    lines = [json.loads(t.value) for t in spark.read.text(f"{path}/relationships").collect()]
    a = {"labels": ["Concept"], "properties": {"title": "A", "definition": "about", "difficulty": "beginner", "aliases": ["a", "é"], "mention_count": 3}}
    b = {"labels": ["Concept"], "properties": {"title": "B", "aliases": [], "mention_count": 1}}
    web = {"labels": ["Resource"], "properties": {"url": "http://x", "type": "web"}}
    want = [{"from": a, "type": "is-a", "properties": {"count": 2}, "to": b}, {"from": web, "type": "EXPLAINS", "properties": {}, "to": a}]
    assert sorted(lines, key=lambda t: t["type"]) == sorted(want, key=lambda t: t["type"])
    assert sorted((json.loads(t.value) for t in spark.read.text(f"{path}/nodes").collect()), key=str) == sorted([a, b, web], key=str)
    nodes, rels = io.read_graph(spark, path)
    # unlabelled and keyless nodes are skipped, and so are relationships without a known end; the last properties stand
    p = F.col("properties")
    odd = nodes.where("properties.title = 'A'")
    more = reduce(DataFrame.unionByName, [odd.withColumn("labels", F.array().cast("array<string>")), odd.withColumn("labels", F.lit(None).cast("array<string>")), odd.withColumn("properties", p.withField("title", F.lit(None).cast("string"))), odd.withColumn("properties", p.withField("definition", F.lit("zzz")))])
    lost = rels.where("type = 'is-a'").withColumn("to", F.col("to").withField("properties", F.col("to.properties").withField("title", F.lit("unknown"))))
    unlabelled = rels.where("type = 'is-a'").withColumn("from", F.col("from").withField("labels", F.lit(None).cast("array<string>")))
    late = rels.where("type = 'is-a'").withColumn("properties", F.col("properties").withField("count", F.lit(1).cast("long")))
    at = lambda df, n: df.withColumn("at", F.lit(n))
    got, edges = io.graph_import(at(more, 1).unionByName(at(nodes, 2)), reduce(DataFrame.unionByName, [at(rels, 1), at(lost, 1), at(unlabelled, 1), at(late, 2)]), "at")
    assert {(q.label, q.key): q.properties.definition for q in got.collect()} == {("Concept", "A"): "about", ("Concept", "B"): None, ("Resource", "http://x"): None}
    assert {(q.from_key, q.type, q.to_key): q.properties["count"] for q in edges.collect()} == {("A", "is-a", "B"): 1, ("http://x", "EXPLAINS", "A"): None}
    assert io.graph_import(nodes.limit(0), rels)[1].count() == 0


def test_state_of_a_folder_changes_with_its_files(spark, tmp_path):
    f = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(f)
    a, again = state_of(spark, str(tmp_path)), state_of(spark, str(tmp_path))
    spark.range(4).write.mode("append").parquet(f)
    assert a == again != state_of(spark, str(tmp_path))


def test_sources_stay_rows(spark):
    m = spark.createDataFrame([("1", 0, "u1", "Tree"), ("1", 1, "u1", "trees"), ("2", 0, "u2", "Tree"), ("2", 1, "", "Tree"), ("3", 0, None, "Leaf")], "chunk_id string, pos int, source_url string, title string")
    m = m.selectExpr("*", "'d' as definition", "cast(null as string) as difficulty", "cast(null as string) as alias")
    lead = C.exact_leaders(C.title_groups(C.normalized(m)))
    sources, concepts = C.sources_of(m, lead), C.canonical(m, lead, sources=False)
    lists = {r.title: r.source_urls for r in C.canonical(m, lead).collect()}
    assert {(u, t) for t, us in lists.items() for u in us} == {tuple(r) for r in G.explains_edges(concepts, sources).collect()}
    assert {tuple(r) for r in G.resources_by_type(G.resource_vertices(sources)).collect()} == {("web", 2)} and "source_urls" not in concepts.columns
