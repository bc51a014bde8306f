"""Readers and writers: JSON arrays, exports with defaults, upserts, graph export and import, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, MapType, StructType


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array of objects a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str, rows: int = 1000) -> None:
    """Text files with one JSON array of about `rows` objects each, dealt by key."""
    files = df.count() // rows + 1
    text = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("file"), F.to_json(F.struct(*df.columns)).alias("row"))
    whole = text.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    whole.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, compressed: ends of relationships repeat their properties in every line."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def export_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    text = lambda c, d="": F.coalesce(c, F.lit(d)).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = chunks.select("chunk_id", text("text"), text("source_url"), text("source_type", "unknown"), text("source_title"), number("chunk_index"), number("token_count"))
    return out if limit is None else out.orderBy("chunk_id").limit(limit)


def import_extractions(rows: DataFrame, stamp: bool = True) -> DataFrame:
    kinds = dict((f.name, f.dataType) for f in rows.schema)
    empty = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c)
    out = rows.select("chunk_id", F.coalesce("source_url", F.lit("")).alias("source_url"), empty("concepts"), empty("relations"), "error", F.coalesce("raw_response", F.lit("")).alias("raw_response"))
    return out.withColumn("imported_at", F.current_timestamp()) if stamp else out


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: columns of the last update, null or not, replace the base's; columns it lacks stay."""
    names = [c for c in updates.columns if c not in (key, version)]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("_new"))
    joined = base.join(last, key, "full_outer")
    put = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)).alias(c) if c in names else F.col(c) for c in dict.fromkeys([*base.columns, *names])]
    return joined.select(*put)


def upsert_counts(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    u = updates.select(key).distinct().join(base.select(key).withColumn("_old", F.lit(1)), key, "left")
    return u.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


#: Properties of an exported node of any label, and of a relationship; JSON leaves out those that are null.
NODE = "title string, definition string, difficulty string, aliases array<string>, mention_count long, url string, type string, example_id string, text string, concept string, example_type string, chunk_id string, source_url string"
RELATIONSHIP = "count long"
KEYS = ("title", "url", "example_id")


def _fields(schema: str, given: DataFrame) -> Column:
    return F.struct(*[(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in schema.split(", "))])


def _label_and_key(labels: Column, properties: Column) -> tuple[Column, Column]:
    """What tells a node: all its labels, null where it has none, and its title, else its url, else its example_id."""
    return F.when(F.size(labels) > 0, F.array_join(labels, ":")), F.coalesce(*[properties[k] for k in KEYS])


def graph_export(vertices: DataFrame, resources: DataFrame, explains: DataFrame, edges: DataFrame, examples: DataFrame | None = None, exemplifies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: labels, properties; relationships: from {labels, properties}, type, properties, to {labels, properties}); relationships without one of their ends are left out."""
    node = lambda df, label: df.select(F.array(F.lit(label)).alias("labels"), _fields(NODE, df).alias("properties"))
    nodes = {"Concept": node(vertices, "Concept"), "Resource": node(resources, "Resource")}
    if examples is not None:
        nodes["Example"] = node(examples, "Example")
    key = _label_and_key(F.col("labels"), F.col("properties"))[1]

    def rel(df: DataFrame, a: str, source: str, kind: Column, b: str, target: str) -> DataFrame:
        # ends are joined with their own label's nodes only, the start first, which has more rows and fewer properties where it is no concept
        out = df.select(F.col(source).alias("a_key"), kind.alias("type"), _fields(RELATIONSHIP, df).alias("properties"), F.col(target).alias("b_key"))
        for end, label, whole in (("a", a, "from"), ("b", b, "to")):
            out = out.join(nodes[label].select(key.alias(f"{end}_key"), F.struct("labels", "properties").alias(whole)), f"{end}_key")
        return out.select("from", "type", "properties", "to")

    rels = rel(edges, "Concept", "source", F.col("rel_type"), "Concept", "target").unionByName(rel(explains, "Resource", "url", F.lit("EXPLAINS"), "Concept", "concept"))
    if exemplifies is not None and examples is not None:
        rels = rels.unionByName(rel(exemplifies, "Example", "example_id", F.lit("EXEMPLIFIES"), "Concept", "concept"))
    return reduce(DataFrame.unionByName, nodes.values()), rels


def write_graph(nodes: DataFrame, relationships: DataFrame | None, path: str) -> None:
    """Nodes and, where given, relationships under path."""
    write_json(nodes, f"{path}/nodes")
    if relationships is not None:
        write_json(relationships, f"{path}/relationships")


_NODE_ROW = f"labels array<string>, properties struct<{NODE.replace(' ', ':').replace(',:', ', ')}>"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODE_ROW).json(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    node = _NODE_ROW
    end = f"struct<{node.replace(' array', ':array').replace('properties ', 'properties:')}>"
    rel = f"`from` {end}, type string, properties struct<{RELATIONSHIP.replace(' ', ':')}>, `to` {end}"
    return read_nodes(spark, path), spark.read.schema(rel).json(f"{path}/relationships")


def _keyed(nodes: DataFrame) -> DataFrame:
    label, key = _label_and_key(F.col("labels"), F.col("properties"))
    return nodes.withColumns({"label": label, "key": key}).where("label is not null and key is not null")


def _last(columns: list[str], order: str | None) -> Column:
    return F.max_by(F.struct(*columns), F.struct(*([order] if order else []), F.to_json("properties")))


def import_nodes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """The nodes of graph_import()."""
    return _keyed(nodes).groupBy("label", "key").agg(_last(["labels", "properties"], order).alias("x")).select("label", "key", "x.*")


def graph_import(nodes: DataFrame, relationships: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(label, key, labels, properties) and (from_label, from_key, type, to_label, to_key, properties): one row per node and per relationship between known nodes.

    Nodes without a label or key, and relationships without a type, are left out.
    Of equals the properties of the last by the column `order` stand (of the
    greatest as JSON where it ties or is not given).
    """
    r = relationships.where("type is not null")
    # ends are told by label and key before anything is joined, so that their properties are not carried on
    for end in ("from", "to"):
        label, key = _label_and_key(F.col(f"{end}.labels"), F.col(f"{end}.properties"))
        r = r.withColumns({f"{end}_label": label, f"{end}_key": key})
    r = r.drop("from", "to")
    ends = ["from_label", "from_key", "type", "to_label", "to_key"]
    r = r.groupBy(*ends).agg(_last(["properties"], order).alias("x")).select(*ends, "x.properties")
    known = _keyed(nodes).select("label", "key").distinct()
    for end in ("from", "to"):
        r = r.join(known.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(f"{end}_key")), [f"{end}_label", f"{end}_key"], "left_semi")
    return import_nodes(nodes, order), r.select(*ends, "properties")


def checksum(df: DataFrame) -> Column:
    """Sum over rows of 60 bits of the MD5 of their columns' texts: the same in any order of rows, and told apart from one with a row twice or less."""
    texts = [F.coalesce(F.when(F.col(c).isNotNull(), F.concat(F.lit("="), F.to_json(F.struct(c)) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(c).cast("string"))), F.lit("-")) for f in df.schema for c in [f.name]]
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *texts)), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet under path, and the manifest (name, rows, columns, checksum, taken_at) in path/_manifest, as read back from the files."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = _described({n: spark.read.schema(df.schema).parquet(f"{path}/{n}") for n, df in tables.items()})
    manifest.withColumn("taken_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def _described(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("rows"), checksum(d).alias("checksum")).select(F.lit(n).alias("name"), "rows", F.lit(len(d.columns)).alias("columns"), "checksum") for n, d in tables.items()])


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, found_rows): tables of a snapshot whose rows or checksum are not those of its manifest."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    names = [r.name for r in manifest.select("name").collect()]  # a row a table
    found = _described({n: spark.read.parquet(f"{path}/{n}") for n in names}).select("name", F.col("rows").alias("found_rows"), F.col("checksum").alias("found"))
    return manifest.join(found, "name").where("rows <> found_rows or checksum <> found").select("name", "rows", "found_rows")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, checked against its manifest; a ValueError names those that are damaged."""
    if bad := [r.name for r in damaged(spark, path).orderBy("name").collect()]:
        raise ValueError(f"damaged: {', '.join(bad)}")
    return {r.name: spark.read.parquet(f"{path}/{r.name}") for r in spark.read.parquet(f"{path}/_manifest").select("name").collect()}


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
