"""MinHash near-duplicates with b-bit signatures.

A set of word shingles has `bands * rows` minima. Bands of whole minima find
candidates; what is kept of a minimum are its low bits, packed in planes, and
the bits in which two signatures differ estimate their similarity, corrected
for chance agreement. Full sets decide. Rows are first held against one row of
each of their buckets, the likest of these, in turns at linear cost, which
settle most of any group; what still holds several components after that is
compared in blocks of bounded size, rows of the largest component only with
the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import materialize
from kgspark.llm.components import connected_components
from kgspark.llm.sets import band_keys, factors, minima, shingle_hashes
from kgspark.llm.sets import mixed as _mixed
from kgspark.llm.sets import runs as _runs
from kgspark.llm.sets import with_texts as _with_texts


def planes(low: np.ndarray, bits: int) -> bytes:
    """The low bits of the minima: all first bits, then all second bits, and so on."""
    return b"".join(np.packbits((low >> np.uint64(j)).astype(np.uint8) & 1, bitorder="little").tobytes() for j in range(bits))


def differing(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """a, b (…, bytes of a signature) → bytes whose ones are the minima that differ in a kept bit."""
    x = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], bits, -1)
    return np.bitwise_or.reduce(x, axis=-2)


def estimate(diff: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Similarity from counts of differing minima; two unlike minima agree in all kept bits once in 2^bits."""
    chance = 2.0**-bits
    agree = 1 - np.bitwise_count(diff).sum(axis=-1, dtype=np.int64) / n
    return (agree - chance) / (1 - chance)


def _signatures(docs: DataFrame, shingle: int, seed: int, bands: int, rows: int, bits: int) -> DataFrame:
    """(row, doc_id, text, n, d1, d2, sig, keys) of (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors(bands * rows, seed)
        for b in batches:
            n, d1, d2, sig, keys = [], [], [], [], []
            for text in b.column(2):
                h = np.unique(shingle_hashes(text.as_py(), shingle, seed))
                least = minima(h, by)
                whole = h.tobytes()
                n.append(len(h))
                d1.append(xxhash.xxh64_intdigest(whole, seed))
                d2.append(xxhash.xxh64_intdigest(whole, seed + 1))
                sig.append(planes(_mixed(least), bits) if len(h) else None)
                keys.append(band_keys(least, rows) if len(h) else None)
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            own = [pa.array(n, pa.int64()), signed(d1), signed(d2), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=["row", "doc_id", "text", "n", "d1", "d2", "sig", "keys"])

    return docs.mapInArrow(run, "row long, doc_id long, text string, n long, d1 long, d2 long, sig binary, keys array<long>")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _star_links(pairs: DataFrame, rows: DataFrame, shingle: int, seed: int, percent: int, share: int) -> DataFrame:
    """pairs (v, pivot, n) → those whose full sets are alike, as (u, v). A pivot meets its rows in shares of about `share` shingles."""
    shares = pairs.groupBy("pivot").agg(F.ceil(F.greatest(F.sum("n") / F.lit(share), F.count("*") / F.lit(64))).alias("shares"))
    dealt = pairs.join(shares, "pivot").select("pivot", F.pmod(F.xxhash64("v"), F.col("shares")).alias("at"), F.lit(1).alias("side"), "v")
    heads = dealt.select("pivot", "at").distinct().select("pivot", "at", F.lit(0).alias("side"), F.col("pivot").alias("v"))
    both = materialize(dealt.unionByName(heads), "stars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head = None, None
        for b in batches:
            us, vs = [], []
            for r in b.itertuples(index=False):
                h = np.unique(shingle_hashes(r.text, shingle, seed))
                if not r.side:
                    now, head = r.pivot, h
                elif now == r.pivot and _alike(head, h, percent):
                    us.append(r.pivot)
                    vs.append(r.v)
            yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _with_texts(both, rows).repartition(parts, "pivot", "at").sortWithinPartitions("pivot", "at", "side").select("pivot", "side", "v", "text").mapInPandas(run, "u long, v long")


_BLOCK = ["band", "key", "i", "j"]


def _candidates(r: pd.DataFrame, least: float, percent: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b, as places) of a block, of two tiles or within one, of several components whose estimate allows a link; each pair only in the first band that it shares."""
    sig = np.frombuffer(b"".join(r["sig"]), np.uint8).reshape(len(r), -1)
    n, comp, tile = (r[c].to_numpy() for c in ("n", "comp", "tile"))
    i, j, band = r["i"].iloc[0], r["j"].iloc[0], r["band"].iloc[0]
    many = 8 * sig.shape[1] // bits
    left, right = [], []
    step = max(1, (1 << 15) // len(r))
    for at in range(0, len(r), step):
        some = slice(at, at + step)
        diff = differing(sig[some, None, :], sig[None, :, :], bits)
        near = estimate(diff, many, bits) >= least
        near &= (comp[some, None] != comp) & (100 * np.minimum(n[some, None], n) >= percent * np.maximum(n[some, None], n))
        near &= (tile[some, None] == i) & (tile == j)
        if i == j:
            near &= np.arange(at, at + near.shape[0])[:, None] < np.arange(len(r))
        a, b = np.nonzero(near)
        if len(a):
            apart = np.unpackbits(diff[a, b], axis=-1, bitorder="little").reshape(len(a), -1, rows).any(axis=2)
            first = np.argmin(apart, axis=1) == band
            left.append(a[first] + at)
            right.append(b[first])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _block_links(members: DataFrame, rows: DataFrame, shingle: int, seed: int, percent: int, least: float, band_rows: int, bits: int, tile_rows: int, tile_shingles: int) -> DataFrame:
    """members (band, key, v, n, sig, comp) of buckets with several components → verified links (u, v) between components."""
    spark = members.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_comp = members.groupBy("band", "key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    tiles = lambda c, s: F.ceil(F.greatest(c / F.lit(tile_rows), s / F.lit(tile_shingles)))
    sizes = by_comp.groupBy("band", "key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max_by(F.struct("comp", "c", "s"), F.struct("c", "comp")).alias("home"))
    whole = tiles(F.col("c"), F.col("s"))
    sizes = sizes.select("band", "key", F.when(whole > 1, F.col("home.comp")).alias("home"), F.when(whole > 1, tiles(F.col("c") - F.col("home.c"), F.col("s") - F.col("home.s"))).otherwise(whole).alias("rest"), F.when(whole > 1, tiles(F.col("home.c"), F.col("home.s"))).otherwise(0).alias("homes"))
    at_home = F.coalesce(F.col("comp") == F.col("home"), F.lit(False))
    tiled = members.join(sizes, ["band", "key"]).withColumn("tile", F.when(at_home, F.col("rest") + F.pmod(F.xxhash64("v"), F.col("homes"))).otherwise(F.pmod(F.xxhash64("v"), F.col("rest"))))
    # a tile meets itself and each other one of its bucket, but for those of the largest component among themselves
    others = F.sequence(F.lit(0).cast("long"), F.when(at_home, F.col("rest")).otherwise(F.col("rest") + F.col("homes")) - 1)
    met = tiled.withColumn("o", F.explode(others)).select("*", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"))
    kept = [*_BLOCK, "tile", "v", "n", "comp", "sig"]

    def involved(r: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = _candidates(r, least, percent, band_rows, bits)
        if len(a):
            yield r.iloc[np.unique(np.concatenate([a, b]))][kept]

    schema = "band int, key long, i long, j long, tile long, v long, n long, comp long, sig binary"
    sort = lambda d: d.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK)
    asked = materialize(sort(met.select(*kept)).mapInPandas(_runs(_BLOCK, involved), schema), "involved")

    def links(r: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, b = _candidates(r, least, percent, band_rows, bits)
        sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in r["text"]]
        comp, v = r["comp"].to_numpy().copy(), r["v"].to_numpy()
        us, vs = [], []
        for x, y in zip(a.tolist(), b.tolist()):
            if comp[x] != comp[y] and _alike(sets[x], sets[y], percent):
                comp[comp == comp[y]] = comp[x]
                us.append(v[x])
                vs.append(v[y])
        yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return sort(_with_texts(asked, rows)).mapInPandas(_runs(_BLOCK, links), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 85, bands: int = 32, rows: int = 5, bits: int = 8, deviations: float = 5.5, seed: int = 42, tile_rows: int = 128, tile_shingles: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Documents are linked whose sets of distinct word shingles (of all words,
    where there are fewer) share `percent` of their union; component_id is the
    smallest id reachable, kept says that it is the row's own. Wordless and null
    texts have no shingles and are linked with nothing. Rows with a null id
    link others and get the smallest id of their component, null if it has
    none; they are kept only then. Repeated rows stay, an empty table gives no
    rows, other columns are not read.

    A pair at the threshold shares no band with probability
    (1 - 0.85^rows)^bands, 7e-9 as set, and is dropped by the estimate beyond
    `deviations` standard errors below it; all else is decided on full sets.
    Equal sets are one vertex. A block holds two tiles of tile_rows rows and
    about tile_shingles shingles, and hands on a forest of its links.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_rows = materialize(_signatures(numbered, shingle, seed, bands, rows, bits), "signatures")
    sets = all_rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("v"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    sets = materialize(sets, "sets")
    signs = sets.select("v", "n", "sig")

    keyed = sets.select("v", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("band", "key")
    members = materialize(keyed.join(buckets, ["band", "key"]), "members").withColumn("comp", F.col("v"))

    share = percent / 100
    least = share - deviations * math.sqrt(share * (1 - share) / (bands * rows))
    def estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(len(b), -1) for c in ("sig", "sig2"))
                found = estimate(differing(x, y, bits), bands * rows, bits)
                yield pd.DataFrame({"v": b["v"], "pivot": b["pivot"], "n": b["n"], "like": found})[found >= least]

    star, comps, before, turn = None, None, 0, 0
    while True:
        placed = members if comps is None else members.drop("comp").join(comps.withColumnRenamed("id", "v"), "v", "left").select("band", "key", "v", F.coalesce("component", "v").alias("comp"))
        several = placed.groupBy("band", "key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("band", "key")
        members = materialize(placed.join(several, ["band", "key"]), "open_members")
        by_comp = members.groupBy("band", "key", "comp").agg(F.count("*").cast("double").alias("c")).groupBy("band", "key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
        work = by_comp.agg(F.sum(F.col("n") * F.col("n") - F.col("same"))).first()[0] or 0  # pairs of rows of unlike components
        if not work or turn > 1 and work > 0.75 * before:
            break
        # first the least row of a bucket, then another one in each band and turn; rows of its own component pass it by
        first = F.struct(F.xxhash64("v", "band", F.lit(turn)) if turn else F.lit(0).cast("long"), "v", "comp")
        pivots = members.groupBy("band", "key").agg(F.min(first).alias("p")).select("band", "key", F.col("p.v").alias("pivot"), F.col("p.comp").alias("of"))
        pairs = members.join(pivots, ["band", "key"]).where("comp <> of").select("v", "pivot").distinct()
        pairs = pairs.join(signs, "v").join(signs.select(F.col("v").alias("pivot"), F.col("n").alias("n2"), F.col("sig").alias("sig2")), "pivot")
        pairs = pairs.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
        near = pairs.select("v", "pivot", "n", "sig", "sig2").mapInPandas(estimates, "v long, pivot long, n long, like double")
        best = near.groupBy("v", "n").agg(F.max_by("pivot", F.struct("like", -F.col("pivot"))).alias("pivot"))
        found = _star_links(best, all_rows, shingle, seed, percent, 1 << 16)
        star = materialize(found if star is None else star.unionByName(found), "star_links")
        comps = connected_components(star)
        before, turn = work, turn + 1

    block = materialize(_block_links(members.join(signs, "v"), all_rows, shingle, seed, percent, least, rows, bits, tile_rows, tile_shingles), "block_links")
    comps = connected_components(block if star is None else star.unionByName(block))

    by_set = sets.join(comps, sets.v == comps.id, "left").select("n", "d1", "d2", "least", F.coalesce("component", "v").alias("part"))
    ids = by_set.groupBy("part").agg(F.min("least").alias("component_id"))
    by_set = by_set.join(ids, "part").select("n", "d1", "d2", "component_id")
    out = all_rows.select("doc_id", "n", "d1", "d2").join(by_set, ["n", "d1", "d2"], "left")
    of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"), F.col("doc_id").eqNullSafe(of).alias("kept"))
