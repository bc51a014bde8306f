"""Exact top-k inner products by norm buckets with local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import materialize

TILE = "bucket int, n int, dim int, ids binary, codes binary"
FOUND = "query_id long, vec_id long, score long"
PER_OCTAVE = 4  # norm buckets to a doubling of the norm
EXACT = float(1 << 53)
COORDINATE = 0.85  # local cosine threshold from which coordinates prune
FOCUS = 3  # coordinates that are looked at


def codes(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, codes array<double>, norm2): floor(scale * x), x as double, kept as exact doubles; unusable vectors left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # beyond 2^53 a double is whole; below, its floor fits a long, and tiny negatives go to -1
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    out = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: floor(x * scale)).alias("codes"))
    return out.withColumn("norm2", F.aggregate("codes", F.lit(0.0), lambda a, x: a + x * x))


def matrix(lists, dim: int) -> np.ndarray:
    """Rows of equal length; shorter vectors count as having zeros at their ends."""
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where every partial sum is exact, by Python's integers otherwise."""
    if q.size and c.size and q.shape[1] * np.abs(q).max() * np.abs(c).max() >= EXACT:
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q], dtype=object)
    return (q @ c.T).astype(np.int64)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["norm2", "vec_id"], ascending=[False, True])
    dim = max(map(len, rows["codes"]))
    return pd.DataFrame(
        {"bucket": [rows["bucket"].iloc[0]], "n": [len(rows)], "dim": [dim], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "codes": [matrix(rows["codes"], dim).astype("<f8").tobytes()]}
    )


def bucketed(coded: DataFrame, tile_rows: int = 4096) -> DataFrame:
    """Tiles of vectors of like norm, each sorted by falling norm; a bucket of any size is many tiles."""
    bucket = F.when(F.col("norm2") > 0, F.floor(F.log2("norm2") * (PER_OCTAVE / 2))).otherwise(-1).cast("int")
    keyed = coded.withColumn("bucket", bucket)
    # a few thousand buckets at most: doubles have 2,048 octaves
    parts = keyed.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("chunks"))
    keyed = keyed.join(F.broadcast(parts), "bucket").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "codes"), F.col("chunks")))
    return keyed.drop("chunks").groupBy("bucket", "chunk").applyInPandas(_pack, TILE)


def search_tile(ids: np.ndarray, c: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): of each query the k best of a tile whose score is not under least.

    c is sorted by falling norm. A query whose norm times the largest norm here
    is under its least score needs nothing from this tile. Where its local
    cosine threshold is high, the coordinates in which it is largest bound the
    vectors that can reach it; otherwise the norms do, which keeps a prefix.
    What is left is verified by full products.
    """
    norm = np.sqrt((c * c).sum(axis=1))
    q_norm = np.sqrt((q * q).sum(axis=1))
    slack = 1 + 1e-9
    out: list[tuple[int, int, int]] = []
    open_ = np.flatnonzero((least <= 0) | (q_norm * norm[0] * slack >= least))
    if not len(open_):
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norm * norm[0] > 0, least / (q_norm * norm[0]), 0.0)
        short = np.where(q_norm > 0, least / q_norm, 0.0)
        unit = np.where(norm[:, None] > 0, c / norm[:, None], 0.0)

    def best(i: int, rows: np.ndarray, score: np.ndarray) -> None:
        ok = (score >= least[i]) & (ids[rows] != q_ids[i])
        rows, score = rows[ok], score[ok]
        if len(rows) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k] if score.dtype != object else sorted(score)[-k]
            rows, score = rows[score >= cut], score[score >= cut]
            first = sorted(range(len(rows)), key=lambda j: (-score[j], ids[rows[j]]))[:k]
            rows, score = rows[first], score[first]
        out.extend((int(q_ids[i]), int(ids[r]), int(s)) for r, s in zip(rows, score))

    by_length = []
    for i in open_:
        t = min(local[i] / slack, 1.0)
        if t < COORDINATE:
            by_length.append(i)
            continue
        qu = q[i] / q_norm[i]
        focus = np.argsort(-np.abs(qu))[:FOCUS]
        near = np.ones(len(c), bool)
        for f in focus:
            wide = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - qu[f] * qu[f])) + 1e-9
            # with the angle between them bounded, so is each coordinate
            near &= (unit[:, f] >= (qu[f] * t - wide if qu[f] > -t else -1.0)) & (unit[:, f] <= (qu[f] * t + wide if qu[f] < t else 1.0))
        rows = np.flatnonzero(near & (norm * slack >= short[i]))
        if len(rows):
            best(i, rows, products(q[i : i + 1], c[rows])[0])
    for at in range(0, len(by_length), 256):
        part = np.array(by_length[at : at + 256])
        keep = max(int(np.searchsorted(-norm * slack, -short[i], side="right")) if least[i] > 0 else len(c) for i in part)
        score = products(q[part], c[:keep])
        for j, i in enumerate(part):
            best(i, np.arange(keep), score[j])
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, tile_rows: int = 4096, block_bytes: int = 32 << 20, probes: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    Scores are integer inner products of floor(scale * x). Ties go to the
    smaller id; a row that repeats the query's own id is its own. Vectors that
    are null, or hold null or non-finite components, and rows without an id take
    no part; shorter vectors count as padded with zeros; repeated query rows ask
    once; fewer candidates give fewer rows, an empty table none. Queries go to
    the tasks in blocks of block_bytes, each block with its own pass over the
    tiles and a result that is written before the next one, so any number of
    them works; scores of the `probes` longest vectors, one of each id, give each
    query its first threshold.
    """
    spark = vectors.sparkSession
    coded = materialize(codes(vectors, scale, id_col, vector_col), "codes")
    tiles = materialize(bucketed(coded, tile_rows), "tiles")
    asked = coded.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("codes").alias("codes"))
    size = asked.agg(F.count("*"), F.max(F.size("codes"))).first()
    blocks = (size[0] or 0) * 8 * (size[1] or 0) // block_bytes + 1
    if blocks > 1:
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).sort("block"), "asked")
    else:
        asked = asked.withColumn("block", F.lit(0))
    head = coded.orderBy(F.desc("norm2"), "vec_id").limit(probes).collect()
    head = list({r.vec_id: r for r in reversed(head)}.values())  # of a repeated id the longest
    widest = max([size[1] or 0, *(len(r.codes) for r in head)])
    probe_ids, probe = np.array([r.vec_id for r in head], dtype=np.int64), matrix([r.codes for r in head], widest)
    found = None
    for b in range(blocks):
        rows = asked.where(F.col("block") == b).orderBy("vec_id").collect()
        q_ids, q = np.array([r.vec_id for r in rows], dtype=np.int64), matrix([r.codes for r in rows], widest)
        least = np.full(len(rows), -np.inf)
        for i in range(0, len(rows), 256):
            score = products(q[i : i + 256], probe).astype(float)
            score[q_ids[i : i + 256, None] == probe_ids[None, :]] = -np.inf
            if score.shape[1] >= k:
                least[i : i + 256] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        shared = spark.sparkContext.broadcast((q_ids, q, least))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q_ids, q, least = shared.value
            for batch in batches:
                for t in batch.itertuples(index=False):
                    ids, c = np.frombuffer(t.ids, "<i8"), np.frombuffer(t.codes, "<f8").reshape(t.n, t.dim)
                    dim = max(t.dim, q.shape[1])
                    pad = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))
                    got = search_tile(ids, pad(c), q_ids, pad(q), least, k) if len(q_ids) else []
                    if got:
                        yield pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

        part = tiles.mapInPandas(run, FOUND)
        if blocks > 1:
            part = materialize(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
