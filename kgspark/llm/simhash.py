"""SimHash near-duplicates: fingerprints, then exact tiled comparison.

Distinct fingerprints are cut into tiles by the population counts of their two
32-bit halves. Hamming distance is at least the sum of the differences of
those counts, so tile pairs further apart than the radius are never formed.
The remaining pairs are compared in numpy by exclusive-or and bit counts, and
each tile pair hands on a spanning forest of its links, never the links
themselves: a group of thousands of near copies costs thousands of rows.

similar_groups() is another measure, Jaccard similarity of sets of shingles,
and finds its candidates by bands of minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.llm.common import materialize
from kgspark.llm.components import connected_components
from kgspark.llm.sets import band_keys, factors, minima, runs, shingle_hashes, with_texts

HALF = 0xFFFFFFFF


def set_fingerprint(h: np.ndarray, block: int = 1 << 15) -> int:
    """SimHash of the given hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), block):
        ones += np.unpackbits(h[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 if it has no words."""
    h = shingle_hashes(text, shingle, seed)
    if not len(h):
        return 0
    return set_fingerprint(h, block)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, other: np.ndarray, ids: np.ndarray, ids2: np.ndarray, same: bool, radius: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (u, smallest id linked to u) of the links between two tiles; at_once pairs are compared in one step."""
    n, m = len(fps), 0 if same else len(other)
    rows = max(1, at_once // len(other))
    label = np.arange(n + m)
    left, right = [], []
    kept = 0

    def settle() -> None:
        nonlocal kept
        if not left:
            return
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            la, lb = label[a], label[b]
            if not (differ := la != lb).any():
                break
            low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
            np.minimum.at(label, high, low)
            while not np.array_equal(up := label[label], label):
                label[:] = up
        left.clear()
        right.clear()
        kept = 0

    for i in range(0, n, rows):
        near = np.bitwise_count(fps[i : i + rows, None] ^ other[None, :]) <= radius
        a, b = np.nonzero(near)
        a = a + i
        if same:
            a, b = a[a < b], b[a < b]
        else:
            b = b + n
        if len(a):
            left.append(a)
            right.append(b)
            kept += len(a)
            if kept > 1_000_000:
                settle()
    settle()
    every = ids if same else np.concatenate([ids, ids2])
    smallest = np.full(n + m, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, every)
    root = smallest[label]
    linked = root != every
    return every[linked], root[linked]


def _tile_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                u, v = _forest(
                    np.frombuffer(r.fps, "<u8"), np.frombuffer(r.fps2, "<u8"), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.ids2, "<i8"), r.tile == r.tile2, radius
                )
                if len(u):
                    yield pd.DataFrame({"u": u, "v": v})

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Binary columns from the lists of a tile."""
    for b in batches:
        yield pd.DataFrame(
            {
                "tile": b["tile"], "a": b["a"], "b": b["b"],
                "fps": [np.array([x["fp"] for x in xs], dtype="<i8").tobytes() for xs in b["xs"]],
                "ids": [np.array([x["rep"] for x in xs], dtype="<i8").tobytes() for xs in b["xs"]],
            }
        )


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = 1 << 15) -> DataFrame:
    """distinct (fp, rep), one row per fingerprint → edges (u, v) of reps whose closure is that of all links.

    A tile goes to a task with each tile it meets, so that the bytes moved fall
    as tiles grow; one of 1 << 15 rows has half a megabyte and meets as many
    others in a billion comparisons.
    """
    spark = distinct.sparkSession
    mask = F.lit(HALF).cast("long")
    keyed = distinct.select("fp", "rep", F.bit_count(F.col("fp").bitwiseAND(mask)).alias("a"), F.bit_count(F.shiftrightunsigned("fp", 32).bitwiseAND(mask)).alias("b"))
    # 33 x 33 counts at most, whatever the input
    parts = keyed.groupBy("a", "b").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("chunks"))
    tiles = (
        keyed.join(F.broadcast(parts), ["a", "b"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        .withColumn("tile", (F.col("a") * 33 + F.col("b")) * F.lit(1 << 32) + F.col("chunk"))
        .groupBy("tile", "a", "b")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("xs"))
        .mapInPandas(_pack, "tile long, a int, b int, fps binary, ids binary")
    )
    tiles = materialize(tiles, "tiles")
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near]))
    names = tiles.select("tile", "a", "b")
    pairs = (
        names.withColumn("s", steps)
        .select("tile", (F.col("a") + F.col("s.x")).alias("a"), (F.col("b") + F.col("s.y")).alias("b"))
        .join(names.select(F.col("tile").alias("tile2"), "a", "b"), ["a", "b"])
        .where("tile <= tile2")
        .select("tile", "tile2")
    )
    wide = pairs.join(tiles.select("tile", "fps", "ids"), "tile").join(tiles.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2"), F.col("ids").alias("ids2")), "tile2")
    wide = wide.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "tile", "tile2")
    return wide.mapInPandas(_tile_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 3, tile_rows: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint string, component_id), one row per input row.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits, the row's own included. Null and wordless texts have
    fingerprint zero and link like any other; rows with a null id get the
    smallest id of their component (null if it has none); repeated rows stay;
    an empty table gives no rows. Only doc ids, never texts, are shuffled.
    """
    prints = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    # a fingerprint is its own vertex, so that rows with a null id link others too
    held = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(links(held.select("fp", F.col("fp").alias("rep")), radius, tile_rows))
    by_fp = held.join(parts, held.fp == parts.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    ids = by_fp.groupBy("part").agg(F.min("least").alias("component_id"))
    by_fp = by_fp.join(ids, "part").select("fp", "component_id")
    return prints.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signed(docs: DataFrame, shingle: int, seed: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, keys) of (doc_id, text): size and digests of the set of shingles, and a key for each band of its minima, null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = factors(bands * rows, seed)
        for b in batches:
            n, d1, d2, keys = [], [], [], []
            for text in b["text"]:
                h = np.unique(shingle_hashes(text, shingle, seed))
                n.append(len(h))
                d1.append(xxhash.xxh64_intdigest(whole := h.tobytes(), seed + 1))
                d2.append(xxhash.xxh64_intdigest(whole, seed + 2))
                keys.append(band_keys(minima(h, by), rows) if len(h) else None)
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "d1": signed(d1), "d2": signed(d2), "keys": keys})

    return docs.mapInPandas(run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


def _block_links(shingle: int, seed: int, least: float):
    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Forest of the pairs of a block's texts, of both sides or among those of side 0 alone, whose sets of shingles have the similarity."""
        rows = rows.sort_values("v")
        ids, left = rows["v"].to_numpy(), (rows["side"] == 0).to_numpy()
        sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in rows["text"]]
        sizes = np.array([len(v) for v in sets])
        _, flat, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sets)), sizes)
        kept = often[flat] > 1  # what one text alone has is in no intersection
        flat, of = flat[kept], of[kept]
        starts = np.searchsorted(of, np.arange(len(sets) + 1))
        part, held = np.arange(len(sets)), np.zeros(len(often), bool)
        us, vs = [], []
        alone = not (~left).any()
        for u in np.flatnonzero(left):
            other = part != part[u]
            if not alone:
                other &= ~left
            if not other.any():
                continue
            mine = flat[starts[u] : starts[u + 1]]
            held[mine] = True
            both = np.diff(np.concatenate([[0], np.cumsum(held[flat])])[starts])
            held[mine] = False
            alike = np.flatnonzero(other & (both >= least * (sizes + sizes[u] - both) - 1e-9))
            for v in alike:
                p, q = part[u], part[v]
                if p != q:
                    part[part == max(p, q)] = min(p, q)
                    us.append(ids[u])
                    vs.append(ids[v])
        yield pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})

    return run


_BLOCK = ["cluster", "i", "j"]


def _compared(blocks: DataFrame, texts: DataFrame, shingle: int, seed: int, least: float) -> DataFrame:
    """blocks (cluster, i, j, side, v) → verified links (u, v); a task holds one block's texts at a time."""
    parts = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_texts(blocks, texts.withColumnRenamed("doc_id", "row")).repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK)
    return materialize(rows.mapInPandas(runs(_BLOCK, _block_links(shingle, seed, least)), "u long, v long"), "links")


def _cluster_links(members: DataFrame, texts: DataFrame, shingle: int, seed: int, least: float, tile_rows: int, tile_shingles: int) -> DataFrame:
    """members (cluster, v, n, led) → verified links (u, v) whose closure is that of all pairs of a cluster.

    A cluster that fits a tile is one block. The rows of a larger one meet its
    leader, the row that most others found; what the leader is not linked with
    is then compared, in tiles, with itself and with what it is linked with.
    """
    tiles = lambda c, s: F.ceil(F.greatest(c / F.lit(tile_rows), s / F.lit(tile_shingles)))
    leader = F.max_by("v", F.struct("led", -F.col("v"))).alias("leader")
    sizes = materialize(members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"), leader).withColumn("tiles", tiles(F.col("c"), F.col("s"))).where("c > 1"), "clusters")
    placed = members.join(sizes.select("cluster", "tiles", "leader"), "cluster")
    side = lambda x: F.lit(x).alias("side")
    whole = placed.where("tiles = 1").select("cluster", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), side(0), "v")
    share = placed.where("tiles > 1 and v <> leader").select("cluster", F.pmod(F.xxhash64("v"), F.col("tiles")).alias("i"), F.lit(-1).cast("long").alias("j"), side(1), "v")
    heads = sizes.where("tiles > 1").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("i"), F.lit(-1).cast("long").alias("j"), side(0), F.col("leader").alias("v"))
    first = _compared(whole.unionByName(share).unionByName(heads), texts, shingle, seed, least)

    large = placed.where("tiles > 1")
    if large.isEmpty():
        return first
    ends = first.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("met", F.lit(True))
    large = large.join(ends, "v", "left").withColumn("home", (F.col("v") == F.col("leader")) | F.coalesce("met", F.lit(False)))
    of = lambda home, x: F.coalesce(F.sum(F.when(F.col("home") == home, x)), F.lit(0))
    split = large.groupBy("cluster").agg(tiles(of(False, F.lit(1)), of(False, F.col("n"))).alias("rest"), tiles(of(True, F.lit(1)), of(True, F.col("n"))).alias("homes")).where("rest > 0")
    tiled = large.join(split, "cluster").withColumn("tile", F.when(F.col("home"), F.col("rest") + F.pmod(F.xxhash64("v"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("v"), F.col("rest"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), F.col("rest")).otherwise(F.col("rest") + F.col("homes")) - 1)
    met = tiled.withColumn("o", F.explode(others)).select("cluster", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), (F.col("tile") > F.col("o")).cast("int").alias("side"), "v")
    return first.unionByName(_compared(met, texts, shingle, seed, least))


def similar_groups(
    docs: DataFrame, shingle: int = 5, least: float = 0.8, bands: int = 40, rows: int = 4, seed: int = 42, tile_rows: int = 4096, tile_shingles: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id) for rows with distinct, non-null ids: closure of pairs whose sets of word shingles have Jaccard `least`.

    Equal sets are one vertex. Sets that share a band of `rows` minima, by way
    of others too, are a cluster: a set sends a short key for each band,
    whatever the table holds besides, and a pair at 0.8 shares none with
    probability (1 - 0.8^rows)^bands, 7e-10 as set, however short its texts.
    All pairs of a cluster are decided on their full sets, in blocks of at most
    two tiles of tile_rows rows and about tile_shingles shingles; a block hands
    on a spanning forest. Only the texts of clusters are shuffled. Wordless
    texts are equal.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(_signed(texts, shingle, seed, bands, rows), "signed")
    sets = materialize(prints.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("v")), "sets")
    # here a set goes by its first digest: two sets that share it would only come into one cluster
    keyed = prints.select("d1", F.explode("keys").alias("key"))
    found = keyed.withColumn("by", F.min("d1").over(W.partitionBy("key"))).where("d1 <> by").groupBy("d1", "by").agg(F.count("*").alias("led"))
    found = materialize(found, "bands")
    clusters = connected_components(found.select(F.col("d1").alias("u"), F.col("by").alias("v"))).withColumnRenamed("component", "cluster")
    led = found.groupBy(F.col("by").alias("id")).agg(F.sum("led").alias("led"))
    members = sets.join(clusters.join(led, "id", "left"), sets.d1 == F.col("id")).select("cluster", "v", "n", F.coalesce("led", F.lit(0)).alias("led"))
    parts = connected_components(_cluster_links(materialize(members, "members"), texts, shingle, seed, least, tile_rows, tile_shingles))
    by_set = sets.join(parts, sets.v == parts.id, "left").select("n", "d1", "d2", F.coalesce("component", "v").alias("component_id"))
    return prints.select("doc_id", "n", "d1", "d2").join(by_set, ["n", "d1", "d2"]).select("doc_id", "component_id")
