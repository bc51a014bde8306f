"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kgspark.llm.common import materialize, n_words


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share sum(sizes) by weight; no share passes cap x size, what is over goes to the others by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[list[tuple[int, int]]]:
    """flow[p]: (source, words) of pattern p routed to its sources, in their order, without zeros.

    Network: start → pattern (one edge per copy r = 1..repeats with capacity
    size and cost r², so that a second copy is used only when firsts are short)
    → its sources → end (capacity: quota). Only edges of start cost anything and
    no shortest path returns there, so shortest paths use up copy 1 first, then
    copy 2 and so on: each copy opens its edges and pushes blocking flows until
    none is left. A pattern that alone shares its only source has one way, and takes it at once.
    """
    users = [0] * len(quotas)
    for members, _ in patterns:
        for s in members:
            users[s] += 1
    out: list[dict[int, int]] = [{} for _ in patterns]
    network = []
    for p, (members, size) in enumerate(patterns):
        if len(members) == 1 and users[members[0]] == 1:
            out[p] = {members[0]: min(repeats * size, quotas[members[0]])}
        else:
            network.append(p)
    room = {s: quotas[s] for p in network for s in patterns[p][0]}
    holders: dict[int, list[int]] = {s: [] for s in room}  # patterns that may send to a source
    for p in network:
        for s in patterns[p][0]:
            holders[s].append(p)
    open_ = dict.fromkeys(network, 0)
    for _ in range(repeats):
        for p in network:
            open_[p] += patterns[p][1]
        while _block(patterns, holders, open_, room, out):
            pass
    return [[(s, n) for s, n in sorted(f.items()) if n] for f in out]


def _block(patterns: list, holders: dict[int, list[int]], open_: dict[int, int], room: dict[int, int], out: list[dict[int, int]]) -> bool:
    """Push one blocking flow along shortest ways; False if there is none.

    A way goes pattern → source → pattern that sends there and can send elsewhere → … → source with room.
    """
    at_p, at_s = {p: 0 for p, n in open_.items() if n}, {}
    front, depth, reached = list(at_p), 0, False
    while front and not reached:
        met = []
        for p in front:
            for s in patterns[p][0]:
                if s not in at_s:
                    at_s[s] = depth
                    met.append(s)
                    reached = reached or room[s] > 0
        front, depth = [], depth + 1
        if reached:
            break
        for s in met:
            for p in holders[s]:
                if p not in at_p and out[p].get(s, 0) > 0:
                    at_p[p] = depth
                    front.append(p)
    if not reached:
        return False
    next_p, next_s = dict.fromkeys(at_p, 0), dict.fromkeys(at_s, 0)
    for first in [p for p, d in at_p.items() if d == 0]:
        way: list[int] = [first]  # patterns and sources in turn
        while open_[first] and way:
            end = way[-1]
            if len(way) % 2:  # a pattern: its next source one step on
                members, i = patterns[end][0], next_p[end]
                if i == len(members):
                    way.pop()
                    if way:
                        next_s[way[-1]] += 1
                elif at_s.get(members[i]) == at_p[end]:
                    way.append(members[i])
                else:
                    next_p[end] += 1
            elif room[end]:
                push = min([open_[first], room[end]] + [out[way[k + 1]][way[k]] for k in range(1, len(way) - 1, 2)])
                open_[first] -= push
                room[end] -= push
                for k in range(0, len(way), 2):
                    out[way[k]][way[k + 1]] = out[way[k]].get(way[k + 1], 0) + push
                for k in range(1, len(way) - 1, 2):
                    out[way[k + 1]][way[k]] -= push
                way = [first]
            else:  # a source without room: a pattern that can make some
                i = next_s[end]
                if i == len(holders[end]):
                    way.pop()
                    next_p[way[-1]] += 1
                elif at_p.get(holders[end][i]) == at_s[end] + 1 and out[holders[end][i]].get(end, 0) > 0:
                    way.append(holders[end][i])
                else:
                    next_s[end] += 1
    return True


def _cutoffs(narrow: DataFrame, quotas: DataFrame, bucket_rows: int) -> DataFrame:
    """(pattern, whole, cutoff, extra): each document is taken `whole` times, and once more where its order is at most cutoff or equals extra.

    narrow has (pattern, order, size). Of a pattern with quota q and size z the
    rest, q mod z, goes to documents in seeded order. The running sum runs over
    groups of order buckets, buckets of about bucket_rows rows, and then inside
    the one bucket where the rest ends, so no task sees a whole pattern. What
    the documents up to the cutoff leave of the rest goes to the one beyond it
    whose size is nearest to that, if it brings the sum nearer.
    """
    n = narrow.groupBy("pattern").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(bucket_rows))).alias("buckets"), F.sum("size").cast("long").alias("pattern_size"))
    plan = quotas.join(n, "pattern").withColumn("whole", F.when(F.col("pattern_size") > 0, F.floor(F.col("quota") / F.col("pattern_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("pattern_size"))
    # plan, sums' edges and cutoffs have one row per membership pattern
    bucket = F.floor(F.shiftrightunsigned("order", 1) / F.lit(float(1 << 63)) * F.col("buckets"))
    keyed = narrow.join(F.broadcast(plan.select("pattern", "buckets", "rest")), "pattern").withColumn("bucket", bucket)
    sums = keyed.groupBy("pattern", F.floor(F.col("bucket") / GROUP).alias("group"), "bucket").agg(F.sum("size").cast("long").alias("in_bucket"), F.first("rest").alias("rest"))
    # where the rest ends among groups of buckets, then among the buckets of that group
    groups = _end_of_rest(sums.groupBy("pattern", "group").agg(F.sum("in_bucket").alias("n"), F.first("rest").alias("rest")), "group", F.lit(0))
    inner = sums.join(F.broadcast(groups.select("pattern", "group", F.col("before").alias("first"))), ["pattern", "group"]).withColumnRenamed("in_bucket", "n")
    edge = _end_of_rest(inner, "bucket", F.col("first"))
    w = W.partitionBy("pattern", "bucket").orderBy("place")
    inside = (
        keyed.join(F.broadcast(edge), ["pattern", "bucket"])
        .groupBy("pattern", "bucket", F.shiftrightunsigned("order", 1).alias("place"), "before", "rest")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("before") + F.sum("size").over(w))
    )
    last = inside.groupBy("pattern").agg(
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))), F.min("place") - 1).alias("cutoff"),
        F.max("rest").cast("long").alias("rest"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.first("before")).cast("long").alias("upto"),
    )
    left = last.where("upto < rest").select("pattern", "cutoff", (F.col("rest") - F.col("upto")).alias("left"))
    place = F.shiftrightunsigned("order", 1)
    beyond = narrow.join(F.broadcast(left), "pattern").where(place > F.col("cutoff")).groupBy("pattern", place.alias("place"), "left").agg(F.sum("size").alias("size"))
    off = F.abs(F.col("size") - F.col("left"))
    extra = beyond.where(off < F.col("left")).groupBy("pattern").agg(F.min_by("place", F.struct(off, "place")).alias("extra"))
    cut = plan.select("pattern", "whole").join(last.select("pattern", "cutoff"), "pattern", "left").join(extra, "pattern", "left")
    return cut.select("pattern", "whole", F.coalesce("cutoff", F.lit(-1)).alias("cutoff"), F.coalesce("extra", F.lit(-1)).alias("extra"))


GROUP = 1000  # buckets summed together first


def _end_of_rest(sums: DataFrame, name: str, first: Column) -> DataFrame:
    """(pattern, <name>, before): the last of the ordered parts with less than the rest before it."""
    before = first + F.coalesce(F.sum("n").over(W.partitionBy("pattern").orderBy(name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("before", before).where("before < rest").groupBy("pattern").agg(F.max(name).alias(name), F.max_by("before", name).alias("before"))


def mix(
    docs: DataFrame,
    weights: Iterable[float] = (1.0, 2.0, 3.0),
    cap: int = 3,
    seed: int = 17,
    bucket_rows: int = 1000,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_patterns: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(documents with mix_pattern, mix_size, mix_copies; sources with source, source_size, target).

    source_col is a string (one source) or an array of strings (overlapping
    sources; duplicates and their order do not matter, null and [] are the null
    source). Sources in code point order, null last, weigh weights repeating.
    Only one row per membership pattern reaches the driver; more patterns than
    max_patterns is an error, not a cut. Rows with the same id and text are
    taken together; documents without words have size 0; an empty table gives
    no rows. All columns of docs are kept beside the three added ones, but for
    those of its own whose names begin with mix_, which are left out.
    """
    docs = docs.select(*[c for c in docs.columns if not c.startswith("mix_")])
    spark = docs.sparkSession
    array = isinstance(docs.schema[source_col].dataType, T.ArrayType)
    members = F.array_sort(F.array_distinct(F.col(source_col))) if array else F.array(F.col(source_col))
    members = F.when(F.size(members) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    key = F.to_json(F.struct(members.alias("s")), {"ignoreNullFields": "false"})
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    narrow = materialize(docs.select(key.alias("pattern"), members.alias("members"), order.alias("order"), n_words(F.col(text_col)).alias("size")), "sizes")
    stats = narrow.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").cast("long").alias("size")).orderBy("pattern").limit(max_patterns + 1).collect()
    if len(stats) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted({s for r in stats for s in r.members}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    size_of = [0] * len(names)
    for r in stats:
        for s in r.members:
            size_of[place[s]] += r["size"]
    weights = list(weights)
    total = sum(r["size"] for r in stats)
    share = [weights[i % len(weights)] for i in range(len(names))]
    target = water_fill(size_of, share, cap) if names else []
    if sum(size_of) > total:  # overlapping sources count a document in each; shares are of what there is
        target = [t * total / sum(size_of) for t in target]
    flow = min_cost_flow([(tuple(place[s] for s in r.members), r["size"]) for r in stats], [round(t) for t in target], cap)
    quotas = spark.createDataFrame([(r.pattern, sum(n for _, n in f)) for r, f in zip(stats, flow)], "pattern string, quota long")
    sources = spark.createDataFrame([(s, size_of[i], target[i]) for s, i in place.items()], "source string, source_size long, target double")
    cut = materialize(_cutoffs(narrow.drop("members"), quotas, bucket_rows), "cutoffs")
    marked = docs.select(*docs.columns, key.alias("mix_pattern"), n_words(F.col(text_col)).alias("mix_size"), F.shiftrightunsigned(order, 1).alias("mix_place"))
    joined = marked.join(F.broadcast(cut.withColumnRenamed("pattern", "mix_pattern").withColumnsRenamed({"whole": "mix_whole", "cutoff": "mix_cutoff", "extra": "mix_extra"})), "mix_pattern", "left")
    copies = F.coalesce(F.col("mix_whole"), F.lit(0)) + F.coalesce(((F.col("mix_place") <= F.col("mix_cutoff")) | (F.col("mix_place") == F.col("mix_extra"))).cast("long"), F.lit(0))
    return joined.select(*docs.columns, "mix_pattern", "mix_size", copies.alias("mix_copies")), sources


def taken(copies: Column, size: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return (copies * size).cast("long")
