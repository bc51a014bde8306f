"""Prompts, batch inference, cleaning and validation of model output, and its summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASK = (
    "From the teaching text below, list its concepts (title, definition, difficulty: beginner, intermediate or advanced, aliases), relations between them "
    "(source, target, relation_type: prereq_of, is_a, part_of, contrasts_with or sibling) and worked examples (text, concept, example_type: code, math, case_study, walkthrough or diagram). "
    'Answer with one JSON object {"concepts": [], "relations": [], "examples": []} and nothing else.\n\nTEXT:\n'
)
RESULT = "chunk_id string, source_url string, concepts array<struct<title:string,definition:string,difficulty:string,aliases:array<string>>>, relations array<struct<source:string,target:string,relation_type:string>>, examples array<struct<text:string,concept:string,example_type:string>>, error string, raw_response string"


def prompts(chunks: DataFrame, limit: int = 3500) -> DataFrame:
    return chunks.select("chunk_id", F.concat(F.lit(ASK), F.substring(F.coalesce("text", F.lit("")), 1, limit)).alias("prompt"))


def infer(rows: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 32, column: str = "prompt") -> DataFrame:
    """rows with raw_text, the user's model being called on batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("raw_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(raw_text=[t for i in range(0, len(b), batch) for t in model(list(b[column].iloc[i : i + batch]))])

    return rows.mapInPandas(run, schema)


# fixed forms around an answer: thinking before it, code fences about it
THOUGHT = r"(?s)\A(?=.*<think>).*?</think>"
FENCE = r"\A\s*(?:```json)?(?:```)?|```\s*\z"
MARGIN = r"(?U)\A\s+|\s+\z"


def clean(text: Column) -> Column:
    """The first brace-balanced object of a model's answer, without thinking and fences; what follows its first brace if it never closes. Braces inside strings count."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), THOUGHT, ""), FENCE, ""), MARGIN, "")
    # pieces end behind their brace; what stands before the first { goes
    pieces = F.split(F.when(F.contains(bare, F.lit("{")), F.regexp_replace(bare, r"\A[^{]+", "")).otherwise(bare), r"(?<=[{}])", -1)

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x.endswith("{"), 1).when(x.endswith("}"), -1).otherwise(0)
        shut = (depth == 0) & (x.endswith("{") | x.endswith("}"))
        return F.when(acc["shut"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), shut.alias("shut")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("shut"))
    # the pieces are named once: a lambda's argument is computed once a row
    return F.get(F.transform(F.array(pieces), lambda xs: F.array_join(F.slice(xs, F.lit(1), F.aggregate(xs, start, step, lambda acc: acc["n"])), "")), 0)


KINDS = (("concepts", ("title", "definition", "difficulty")), ("relations", ("source", "target", "relation_type")), ("examples", ("text", "concept", "example_type")))


def parse(raw: DataFrame) -> DataFrame:
    """(chunk_id, source_url, raw_text) → extractions; a bad answer becomes an error row. JVM only, no shuffle.

    Concepts and relations that are no lists are errors, examples that are none
    count as empty; items that are no objects are left out, fields that are no
    strings are kept as JSON text. An answer with a name twice in one object is an error, as is one without JSON.
    """
    rows = raw.select("chunk_id", "source_url", "raw_text", F.try_parse_json(clean(F.col("raw_text"))).alias("v"))
    item = lambda x, f, t="string": F.try_variant_get(x, f"$.{f}", t)
    self = lambda x, t: F.try_variant_get(x, "$", t)

    def of(kind: str, fields: tuple[str, ...]) -> Column:
        def row(x: Column) -> Column:
            cols = [item(x, f).alias(f) for f in fields]
            if kind == "concepts":
                names = F.transform(item(x, "aliases", "array<variant>"), lambda a: self(a, "string"))
                cols.append(F.coalesce(names, F.array().cast("array<string>")).alias("aliases"))
            return F.struct(*cols)

        return F.transform(F.filter(item(F.col("v"), kind, "array<variant>"), lambda x: self(x, "map<string,variant>").isNotNull()), row)

    listed = lambda kind: item(F.col("v"), kind, "variant").isNull() | item(F.col("v"), kind, "array<variant>").isNotNull()
    error = F.when(F.col("v").isNull(), "JSON parse error").when(self(F.col("v"), "map<string,variant>").isNull(), "not an object")
    for kind in ("concepts", "relations"):
        error = error.when(~listed(kind), f"{kind} is not a list")
    types = dict(p.split(" ", 1) for p in RESULT.split(", "))
    lists = [F.when(error.isNull(), F.coalesce(of(k, f).cast(types[k]), F.array().cast(types[k]))).otherwise(F.array().cast(types[k])).alias(k) for k, f in KINDS]
    return rows.select("chunk_id", "source_url", *lists, error.alias("error"), F.when(F.col("v").isNull(), F.substring(F.coalesce("raw_text", F.lit("")), 1, 500)).alias("raw_response"))


def loose_slice(text: Column) -> Column:
    """From the first { to the last }, or null."""
    t = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(t != "", t)


def loose_parse(text: Column) -> Column:
    """struct<parsed, entities, relationships, raw_response>: the slice as JSON where it is such, else two empty lists and the text."""
    cut = loose_slice(text)
    good = F.try_parse_json(cut).isNotNull()
    got = F.from_json(F.when(good, cut), "entities array<string>, relationships array<string>")
    none = F.array().cast("array<string>")
    return F.struct(good.alias("parsed"), F.coalesce(got["entities"], none).alias("entities"), F.coalesce(got["relationships"], none).alias("relationships"), F.when(~good, text).alias("raw_response"))


def siblings(tagged: DataFrame, block: int = 64) -> DataFrame:
    """(chunk_id, source, target, relation_type): all pairs source < target of a chunk's titles, as sibling candidates.

    Titles are put in blocks of `block`, and pairs are made inside rows of one
    or two blocks, so that no row holds all titles or pairs of a long chunk.
    """
    at = F.row_number().over(W.partitionBy("chunk_id").orderBy("title")) - 1
    blocks = tagged.select("chunk_id", "title").distinct().withColumn("i", F.floor(at / F.lit(block))).groupBy("chunk_id", "i").agg(F.sort_array(F.collect_list("title")).alias("xs"))
    both = blocks.join(blocks.select("chunk_id", F.col("i").alias("j"), F.col("xs").alias("ys")), "chunk_id").where("i <= j")
    ones = both.select("chunk_id", F.explode("xs").alias("source"), "ys").select("chunk_id", "source", F.explode(F.filter("ys", lambda y: y > F.col("source"))).alias("target"))
    return ones.withColumn("relation_type", F.lit("sibling"))


def error_sample(extractions: DataFrame, k: int = 5, width: int = 80) -> DataFrame:
    """The first k failed chunks with the beginning of their errors."""
    return extractions.where("error is not null").select("chunk_id", F.substring("error", 1, width).alias("error")).orderBy("chunk_id").limit(k)


def tag(chunks: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """(chunk_id, title): names (name, title) found as runs of up to `longest` words of a chunk, without case."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9#]+"), lambda w: w != "")
    n = F.size("words")

    def of(k: int) -> Column:
        # a lambda of one argument: a second one would be the place in the list
        runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice("words", i, k), " "))
        return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))

    runs = F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, longest + 1)])))
    grams = chunks.select("chunk_id", words.alias("words")).where("size(words) > 0").select("chunk_id", F.explode(runs).alias("name"))
    # the planner takes exploded runs for as small as their texts and would send them to every task: both sides are sorted instead
    wanted = names.select(F.lower("name").alias("name"), "title").distinct().hint("merge")
    return grams.join(wanted, "name").select("chunk_id", "title").distinct()


def summary(extractions: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    bad = F.count_if(F.col("error").isNotNull())
    return extractions.agg(F.count("*").alias("chunks"), n("concepts"), n("relations"), n("examples"), bad.alias("errors"), F.round(100.0 * bad / F.count("*"), 2).alias("error_percent"))


def explode(extractions: DataFrame, kind: str) -> DataFrame:
    """Rows of concepts, relations or examples of extractions without error, with chunk_id, source_url and pos."""
    return extractions.where("error is null").select("chunk_id", "source_url", F.posexplode(kind).alias("pos", "x")).select("chunk_id", "source_url", "pos", "x.*")
