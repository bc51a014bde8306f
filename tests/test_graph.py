"""Rules of the graph operators on literal rows, against plain Python, and a sample of the registered queries against DuckDB."""

import random
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgspark.functions import urls
from kgspark.functions.fuzzy import lcs_length, normalize_title, ratio, similar_pairs
from kgspark.operators import concepts as C
from kgspark.operators import documents as D
from kgspark.operators import extract as E
from kgspark.operators import pages as P
from kgspark.operators import resources as RS
from kgspark.operators import retrieve as H
from kgspark.operators import traverse as T
from kgspark.operators import vectors as V
from kgspark.sources import io
from kgspark.sources.tables import complete
from kgspark.streaming import upserts

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_and_titles(spark):
    for a, b in [("", ""), ("abc", ""), ("kitten", "sitting"), ("aaaa", "aa"), ("graph", "graphs")]:
        assert lcs_length(a, b) == lcs(a, b)
    rows = spark.createDataFrame([(None, ""), ("", ""), (" Big  Graphs ", "big graph"), ("Loss", "loss"), ("Gas", "gas"), ("Trees", "tree"), ("abs", "abs")], "t string, n string")
    assert rows.where(normalize_title(F.col("t")) != F.col("n")).count() == 0


def test_similar_pairs_and_leaders_equal_greedy(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "title string")
    got = {(r.a, r.b) for r in similar_pairs(df, None, 75.0, False, 10).collect()}
    want = {(a, b) for i, b in enumerate(words) for a in words[:i] if ratio(a, b) >= 75.0}
    assert got == want
    order = words[:]
    rng.shuffle(order)
    groups = spark.createDataFrame([(w, ("", i)) for i, w in enumerate(order)], "norm string, first_seen struct<chunk_id:string,pos:int>")
    pairs = spark.createDataFrame([(a, b) for a, b in want], "a string, b string")
    led = {r.norm: r.leader for r in C.leaders(groups, pairs).collect()}
    of = {}
    for i, w in enumerate(order):
        if w not in of:
            of[w] = w
            for x in order[i + 1 :]:
                if x not in of and (min(w, x), max(w, x)) in want:
                    of[x] = w
    assert led == of


def test_urls(spark):
    base = "https://h.org/a/b?x=1"
    rows = [("https://h.org/a//", "https://h.org/a"), ("/c#f", "https://h.org/c"), ("d.pdf", "https://h.org/a/d.pdf"), ("//o.org/x", "https://o.org/x"), ("?q=1", "https://h.org/a/b?q=1"), ("#z", "https://h.org/a/b?x=1")]
    df = spark.createDataFrame(rows[:5], "h string, n string")
    assert df.where(urls.normalize(F.col("h"), F.lit(base)) != F.col("n")).count() == 0
    rng = random.Random(2)
    bases = ["https://h.org", "https://h.org/", "https://h.org/a/b/c?q=/x/../y", "https://h.org/a//b/", "https://h.org/a/./b/../c/d.html"]
    links = {(rng.choice(bases), rng.choice(["", "/"]) + "/".join(rng.choice(["..", ".", "a", "b.pdf", "..c"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "?x=../y", "/..", "/."])) for _ in range(300)}
    df = spark.createDataFrame([(b, h, urljoin(b, h)) for b, h in links], "b string, h string, n string")
    assert [tuple(r) for r in df.where(urls.resolve(F.col("h"), F.col("b")) != F.col("n")).select("b", "h", "n", urls.resolve(F.col("h"), F.col("b"))).limit(5).collect()] == []
    v = spark.createDataFrame([("https://youtu.be/abc/", "abc"), ("https://www.youtube.com/embed/x_1/2", "x_1"), ("https://www.youtube.com/watch?v=a-b&t=1", "a-b")], "u string, v string")
    assert v.where(urls.video_id(F.col("u")) != F.col("v")).count() == 0


def test_pages(spark):
    html = '<html><head><title> T </title></head><body><nav><a href="/n">n</a></nav><main><p>One  two</p><figure><img src="/i.png" alt="a"><figcaption>cap</figcaption></figure><a href="mailto:x">m</a><a href="p.pdf">p</a></main></body></html>'
    r = P.parse_pages(spark.createDataFrame([("https://h.org/x/", html), ("https://h.org/y", None)], "url string, html string")).orderBy("url").collect()
    assert r[0].title == "T" and [h.href for h in r[0].hrefs] == ["/n", "p.pdf"] and r[0].images[0].context == "cap" and r[0].content == "One two\ncap\nm\np"
    assert r[1].title == "Untitled" and r[1].content == ""


def test_answers(spark):
    rows = [("1", '```json\n{"concepts": [], "relations": []}\n```'), ("2", '<think>{</think>{"concepts": {}}'), ("3", '{"concepts": ['), ("4", 'x {"concepts": [{"title": "A"}], "relations": [], "examples": 3} y }')]
    got = {r.chunk_id: r for r in E.parse(spark.createDataFrame([(a, "u", b) for a, b in rows], "chunk_id string, source_url string, raw_text string")).collect()}
    assert got["1"].error is None and got["2"].error == "concepts is not a list" and got["3"].error.startswith("JSON parse error") and got["4"].concepts[0].title == "A" and got["4"].examples == []


def test_cycles_and_levels(spark):
    e = spark.createDataFrame([("a", "b", "PREREQ_OF"), ("b", "a", "PREREQ_OF"), ("b", "c", "PREREQ_OF"), ("x", "y", "PREREQ_OF")], "source string, target string, rel_type string")
    seeds = spark.createDataFrame([("a",), ("q",)], "seed string")
    assert {(r.title, r.depth) for r in T.prerequisites(seeds, e, 2).collect()} == {("b", 1), ("a", 2)}
    assert {r.seed: r.chain for r in T.longest_chain(seeds, e, 2).collect()} == {"a": ["a", "b", "a"], "q": ["q"]}
    v = spark.createDataFrame([(t,) for t in "abcxyq"], "title string")
    assert {r.title: r.level for r in T.topological_levels(v, e).collect()} == {"a": None, "b": None, "c": None, "x": 0, "y": 1, "q": 0}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, link string")
    start = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert {tuple(r) for r in T.reachable(start("a"), links).collect()} == {("a", 0), ("b", 1), ("c", 2)} and T.reachable(start(), links).count() == 0
    c = spark.createDataFrame([(1, t, i) for i, t in enumerate("cbay")], "query_id long, title string, pos int")
    assert [r.title for r in T.kahn_orders(c, e).orderBy("place").collect()] == ["y", "c", "b", "a"]


def plain_clean(text):
    t, depth = text.strip(), 0
    if "{" not in t:
        return t
    t = t[t.index("{") :]
    for i, ch in enumerate(t):
        depth += {"{": 1, "}": -1}.get(ch, 0)
        if depth == 0:
            return t[: i + 1]
    return t


def plain_components(vs, es):
    """Smallest title that each vertex reaches and is reached from, and the longest way into its component."""
    reach = {}
    for x in vs:
        seen, todo = {x}, [x]
        while todo:
            a = todo.pop()
            new = {t for s, t in es if s == a} - seen
            seen |= new
            todo += new
        reach[x] = seen
    comp = {x: min(y for y in vs if y in reach[x] and x in reach[y]) for x in vs}

    def level(c):
        return max((level(comp[a]) + 1 for a, b in es if comp[b] == c and comp[a] != c), default=0)

    return {(x, comp[x], level(comp[x])) for x in vs}


@pytest.mark.parametrize("n, m, seed", [(12, 14, 1), (30, 40, 2), (4, 0, 3)])
def test_components_and_their_levels(spark, n, m, seed):
    rng = random.Random(seed)
    vs = [f"v{i}" for i in range(n)]
    es = {(rng.choice(vs), rng.choice(vs)) for _ in range(m)}
    v = spark.createDataFrame([(x,) for x in vs], "title string")
    e = spark.createDataFrame([(a, b, "PREREQ_OF") for a, b in es] + [("v0", "v1", "IS_A")] * 2, "source string, target string, rel_type string")
    assert {tuple(r) for r in T.component_levels(v, e).collect()} == plain_components(vs, es)


def test_components_of_a_ring_and_a_missing_end(spark):
    e = spark.createDataFrame([("c", "b", "PREREQ_OF"), ("b", "a", "PREREQ_OF"), ("a", "c", "PREREQ_OF"), ("c", "gone", "PREREQ_OF"), ("gone", "d", "PREREQ_OF")], "source string, target string, rel_type string")
    v = spark.createDataFrame([(x,) for x in "abcd"], "title string")
    assert {tuple(r) for r in T.component_levels(v, e).collect()} == {("a", "a", 0), ("b", "a", 0), ("c", "a", 0), ("d", "d", 2)}


def test_answers_that_are_not_as_asked(spark):
    rows = {
        "list": "[1]", "none": None, "null": '{"concepts": null}', "twice": '{"a": 1, "a": 2}', "items": '{"concepts": [1, {"title": 5, "definition": {"a": [1]}, "aliases": "x"}, null], "relations": [{"source": "s"}]}',
        "long": "x" * 1000, "aliases": '{"concepts": [{"title": "t", "aliases": ["a", null, 2]}], "examples": [{"text": "e"}, []]}',
    }
    got = {r.chunk_id: r for r in E.parse(spark.createDataFrame([(a, "u", b) for a, b in rows.items()], "chunk_id string, source_url string, raw_text string")).collect()}
    assert {k: r.error for k, r in got.items()} == {"list": "not an object", "none": "JSON parse error", "null": "concepts is not a list", "twice": "JSON parse error", "items": None, "long": "JSON parse error", "aliases": None}
    assert got["long"].raw_response == "x" * 500 and got["none"].raw_response == "" and got["list"].raw_response is None
    assert [tuple(c) for c in got["items"].concepts] == [("5", '{"a":[1]}', None, [])] and [tuple(r) for r in got["items"].relations] == [("s", None, None)]
    assert got["aliases"].concepts[0].aliases == ["a", None, "2"] and [tuple(x) for x in got["aliases"].examples] == [("e", None, None)]


def test_offsets_of_parts(spark):
    rows = [("a", i, t) for i, t in enumerate(["x", " ", None, "yé", "", "zzz"] * 500)] + [("b", 0, " "), (None, 3, "q"), (None, 9, "r")]
    df = spark.createDataFrame(rows, "url string, page_no int, text string")
    joined = {u: "\n\n".join(t for k, _, t in sorted((r for r in rows if r[0] == u), key=lambda r: r[1]) if t and t.strip(" ")) for u in ("a", "b", None)}
    got = D.offsets(df, "url", "page_no", 2, band=64).collect()
    assert len(got) == len(rows) and {(r.url, r.n_chars) for r in got} == {(u, len(t)) for u, t in joined.items()}
    for r in got:
        kept = bool(r.text and r.text.strip(" "))
        assert (r.begin is not None) == kept and (not kept or joined[r.url][r.begin : r.begin + len(r.text)] == r.text)
    assert D.offsets(df.where("false"), "url", "page_no", 2).count() == 0


def test_clean_and_context(spark):
    want = {None: "", " ```json\n{}\n``` ": "{}", "``` {a}": "{a}", "x } {a{b}c} d }": "{a{b}c}", "<think>{</think>{b": "{b", "no </think> {c}": "{c}", "plain ```": "plain", "{{": "{{"}
    want |= {"  x ": "x", "{}": "{}", "{ { }": "{ { }", "}}": "}}", "{a}{b}": "{a}", "} {a} {b}": "{a}"}
    rng = random.Random(7)
    want |= {t: plain_clean(t) for t in ("".join(rng.choice("{}{} a\n") for _ in range(rng.randrange(30))) for _ in range(200))}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", E.clean(F.col("t")).alias("c")).collect()
    assert [r for r in rows if r.c != want[r.t]] == []
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    c = spark.createDataFrame([(1, "B", "", "easy", "seed", "B", 1), (1, "A", "what A is", "", "prerequisite", "B", 2)], "query_id long, title string, definition string, difficulty string, relation string, seed string, pos int")
    order = spark.createDataFrame([(1, "A", 0), (1, "B", 1)], "query_id long, title string, place int")
    r = spark.createDataFrame([(1, "u2", "web", ["A", "B", "C", "D"]), (1, "u1", "web", ["A"]), (1, "p", "pdf", ["B"])], "query_id long, url string, type string, concepts array<string>")
    x = spark.createDataFrame([(1, "B", "e1", "code", "do B", "s", 1), (1, "B", "e2", "math", "count B", "", 2)], "query_id long, concept string, example_id string, example_type string, text string, source_url string, r int")
    ch = spark.createDataFrame([(1, 1, ["A", "B"]), (1, 2, ["B"])], "query_id long, rank int, chain array<string>")
    text = """### Concepts, basics first

**1. A** [unknown]
what A is
stands as prerequisite to B

**2. B** [easy]
(not defined)

### Worked examples

#### B
- [code] do B
  from s
- [math] count B

### Where to read on

#### pdf
- p
  on B

#### web
- u1
  on A
- u2
  on A, B, C

### Ways to get there
- A → B"""
    assert {t.query_id: t.context for t in H.context(q, c, order, r, x, ch).collect()} == {1: text, 2: "### Concepts, basics first"}


def test_math_and_upsert(spark):
    t = spark.createDataFrame([("a \\[x\ny\\] \\(z\\)",)], "t string")
    assert t.select(H.math_delimiters(F.col("t"))).first()[0] == "a $$x\ny$$ $z$"
    base = spark.createDataFrame([(1, "a", "c"), (2, "b", "d")], "k int, x string, kept string")
    up = spark.createDataFrame([(1, None, 2), (1, "q", 1), (3, "n", 1)], "k int, x string, v int")
    once = io.upsert(base, up, "k", "v")
    want = {(1, None, "c"), (2, "b", "d"), (3, "n", None)}
    assert {tuple(r) for r in once.collect()} == want and {tuple(r) for r in io.upsert(once, up, "k", "v").collect()} == want


def test_streams_equal_batch(spark, tmp_path):
    src = spark.createDataFrame([(u, i, 404 if i % 2 else None, "timeout", f"m{i}", i) for i, u in enumerate("abcab" * 3)], "url string, t int, status_code int, error_kind string, message string, event_id int")
    src = src.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    src.repartition(3).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    q = upserts.failure_stream(stream, str(tmp_path / "s1"), str(tmp_path / "c1"), every=2)
    q.awaitTermination()
    got = upserts.stored_failures(spark, str(tmp_path / "s1"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in RS.failures(src).collect()}
    assert complete(spark, str(tmp_path / "s1")) == [f"batch={i:09}" for i in range(3)] + [f"upto={1:09}"] and not q.lastProgress["stateOperators"]
    # later attempts, of earlier times too, go on from the store; a merged folder cut short does not count
    late = src.withColumn("ts", F.col("ts") - F.expr("interval 1 day")).limit(7)
    late.write.mode("append").parquet(str(tmp_path / "a"))
    upserts.failure_stream(stream, str(tmp_path / "s1"), str(tmp_path / "c1"), every=2).awaitTermination()
    (tmp_path / "s1" / "upto=000000099").mkdir()
    want = {tuple(r) for r in RS.failures(spark.read.parquet(str(tmp_path / "a"))).collect()}
    assert {tuple(r) for r in upserts.stored_failures(spark, str(tmp_path / "s1")).collect()} == want
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    pages = pages.union(pages.limit(5)).repartition(3)
    pages.write.parquet(str(tmp_path / "p"))
    scope = urls.Scope("none.example.org", ("/",))
    ps = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    q = upserts.discover_stream(ps, scope, str(tmp_path / "store"), str(tmp_path / "c2"))
    q.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "store"))
    found = [r.url for r in stored.collect()]
    assert len(found) == len(set(found)) and set(found) == {r.url for r in RS.discover(upserts.page_resource_links(pages, scope)).collect()}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == len(found) and "rocksdbCommitFlushLatency" in str(q.lastProgress)
    # the same pages once more bring nothing new, and a link keeps its first origin
    before = {r.url: r.discovered_from for r in stored.collect()}
    again = pages.limit(40).withColumn("url", F.concat(F.lit("http://a.example/"), "page_id"))
    again.write.mode("append").parquet(str(tmp_path / "p"))
    upserts.discover_stream(ps, scope, str(tmp_path / "store"), str(tmp_path / "c2")).awaitTermination()
    after = {r.url: r.discovered_from for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert {u: f for u, f in after.items() if u in before} == before


def test_vector_search_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 11), float(i)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = vectors.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = sorted((q, k + 1, i) for q, a in rows if q % 10 == 0 for k, (_, i) in enumerate(sorted((sum((x - y) ** 2 for x, y in zip(a, b)), i) for i, b in rows)[:3]))
    for size in (32 << 20, 24):
        assert sorted((r.query_id, r["rank"], r.id) for r in V.search(vectors, queries, 3, block_bytes=size).collect()) == want


@pytest.mark.parametrize("name", ["p11_page_links", "d06_failure_log", "t04_chunk_documents", "c06_best_title_definition_difficulty", "r03_count_relations", "q09_prerequisite_expansion", "v04_vector_search", "h01_retrieve_concepts"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == sorted(str(tuple(dict(zip(want.columns, r))[n] for n in names)) for r in want.fetchall())
