"""Embedding text, vector rows, batch encoding and top-k search by squared distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.sources.checkpoints import cut


def embedding_text(concepts: DataFrame) -> DataFrame:
    known = F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as: "), F.array_join("aliases", ", ")))
    parts = F.filter(F.array(F.col("title"), F.col("definition"), known), lambda x: x.isNotNull() & (x != ""))
    return concepts.select("title", F.array_join(parts, ". ").alias("document"))


def vector_rows(concepts: DataFrame) -> DataFrame:
    return concepts.where("title is not null and title <> ''").select(
        F.substring(F.md5("title"), 1, 16).alias("id"), "title", F.substring(F.coalesce("definition", F.lit("")), 1, 500).alias("definition"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), "mention_count"
    )


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """A plain encoder for tests: hashed word counts, unit length."""
    import zlib

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % dim] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_words, batch: int = 100, column: str = "document") -> DataFrame:
    """texts with an embedding column; the encoder is the user's, called on batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = [v for i in range(0, len(b), batch) for v in np.asarray(encoder(list(b[column].iloc[i : i + batch].fillna(""))), dtype=np.float32).tolist()]
            yield b.assign(embedding=vectors)

    return texts.mapInPandas(run, schema)


def nearest(batches: Iterator[pd.DataFrame], ids: list, q: np.ndarray, k: int, cells: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """(query_id, id, distance): the k nearest vectors of each batch to each query, ties to smaller ids; at most about `cells` distances are held at once, however many queries there are."""
    for x in batches:
        if not len(x) or not len(ids):
            continue
        v = np.stack(x["embedding"].to_numpy()).astype(np.float64)
        own = x["id"].to_numpy()
        squares = (v * v).sum(1)[None, :]
        step = max(1, cells // len(x))
        for at_ in range(0, len(ids), step):
            part = q[at_ : at_ + step]
            d = np.maximum((part * part).sum(1)[:, None] + squares - 2 * part @ v.T, 0)
            for i, row in enumerate(d, at_):
                kth = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                at = np.flatnonzero(row <= kth)
                at = at[np.lexsort((own[at], row[at]))][:k]
                yield pd.DataFrame({"query_id": ids[i], "id": own[at], "distance": ((v[at] - q[i]) ** 2).sum(1)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, min_score: float | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """vectors (id, embedding), queries (query_id, embedding) → (query_id, rank, id, score): the k nearest, then those of at least min_score.

    score = 1 / (1 + squared distance), to four places; the cut compares it
    unrounded. Queries go out in blocks of block_bytes, each with a pass over the
    vectors and a result that is kept before the next one; a task keeps k rows a query and batch before the shuffle.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = (size[0] or 0) * 4 * (size[1] or 0) // block_bytes + 1
    found = None
    if blocks > 1:
        queries = cut(queries)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return nearest(batches, *shared.value, k)

        part = vectors.select("id", "embedding").mapInPandas(run, f"query_id long, id {vectors.schema['id'].dataType.simpleString()}, distance double")
        if blocks > 1:
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    w = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("raw", 1 / (1 + F.col("distance")))
    if min_score:
        best = best.where(F.col("raw") >= min_score)
    return best.select("query_id", "rank", "id", F.round("raw", 4).alias("score"))


def numbered(rows: DataFrame, by: str, name: str = "id") -> DataFrame:
    """rows with their place (from 0) in the order of `by`: places inside ranges, moved on by the sizes of the ranges before, so that no task orders all rows."""
    parts = cut(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_part").orderBy(by)) - 1
    return parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_before")
