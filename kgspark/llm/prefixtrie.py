"""A trie of conversations by truncation peeling.

Conversations enter at the depth where they end, equal ones as one. From the
greatest depth down, those that end at a depth are merged with what survives
from below it, each merged group is a node, and the node goes on without its
last turn: one pass discovers the nodes and sums up their subtrees.

A node is known by the exclusive or of hashes of its turns and their places.
Rows carry the running keys of a block of turns only, so that a long
conversation costs its length and not its square. Wide levels are grouped by
Spark one by one; bands in which few conversations are left are peeled whole,
group by group, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import materialize

BLOCK = 16  # turns whose keys a row carries
NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, bytes): each turn with its place, from 1. Places are counted within 64 turn numbers and moved by what stands before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    rows = rows.withColumn("part", F.coalesce(F.shiftright("turn", 6), F.lit(-(1 << 62))))
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    narrow = rows.select("conv_id", "part", at.alias("at"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"))
    narrow = materialize(narrow, "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = narrow.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return narrow.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "h1", "h2", "bytes")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lengths, turns): (conv_id, length) of each rebuilt conversation and its turns (conv_id, d, h1, h2, bytes), d from 1.

    Conversation c takes the first h turns of conversation c - c % 5, h being
    crc32 of its decimal id modulo 9, and its own turns after its first h.
    """
    turns = materialize(_turns(conversations), "placed_turns")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own_length"))
    base = own.select(F.col("conv_id").alias("base"), F.col("own_length").alias("base_length"))
    asked = own.select("conv_id", "own_length", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"))
    asked = asked.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_length", F.lit(0))))
    asked = materialize(asked.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("own_length") - F.col("h"))).alias("length")), "rebuilt")
    after = turns.join(asked, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("d"), "h1", "h2", "bytes")
    heads = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).withColumnRenamed("conv_id", "base")
    heads = heads.join(asked.drop("length"), "base").where("pos <= h").select("conv_id", F.col("pos").alias("d"), "h1", "h2", "bytes")
    return asked.select("conv_id", "length"), heads.unionByName(after)


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, b1, b2, up): the key before each block of turns and, in up, key and bytes at each of its depths."""
    keyed = turns.select("conv_id", "d", F.expr(f"(d - 1) div {BLOCK}").alias("block"), F.xxhash64("h1", "h2", "d").alias("k1"), F.xxhash64("d", "h2", "h1").alias("k2"), "bytes")
    blocks = keyed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("d", "k1", "k2", "bytes"))).alias("xs"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.select("conv_id", "block", "xs", *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"b{k}") for k in (1, 2)])

    key = lambda k: f"aggregate(slice(xs, 1, i), b{k}, (a, x) -> a ^ x.k{k}) as k{k}"
    up = F.expr(f"transform(sequence(1, size(xs)), i -> struct({key(1)}, {key(2)}, xs[i - 1].bytes as bytes))")
    return based.select("conv_id", "block", "b1", "b2", up.alias("up"))


def _ended(lengths: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per distinct conversation: (k1, k2, depth, n, conv_id, ends_sha256); the digest runs over pieces of ids in order."""
    last = blocks.select("conv_id", "block", F.element_at("up", -1).alias("u"))
    whole = lengths.withColumn("block", F.expr(f"(length - 1) div {BLOCK}")).join(last, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    ends = whole.select("conv_id", F.col("length").alias("depth"), F.coalesce("u.k1", zero).alias("k1"), F.coalesce("u.k2", zero).alias("k2"))
    node = ["k1", "k2", "depth"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = materialize(ends.groupBy(*node, F.shiftright("conv_id", 10).alias("piece")).agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "ends")
    ended = pieces.groupBy(*node).agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.count("*").alias("pieces"), F.min("ids").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                if now == (key := (r.k1, r.k2, r.depth)):
                    sha.update(b",")
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(r.ids.encode())
            yield pd.DataFrame(done, columns=["k1", "k2", "depth", "sha"])
        if now:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["k1", "k2", "depth", "sha"])

    parts = max(8, int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = pieces.join(ended.where("pieces > 1").select(*node), node, "left_semi").select(*node, "piece", "ids")
    many = many.repartition(parts, *node).sortWithinPartitions(*node, "piece").mapInPandas(digest, "k1 long, k2 long, depth long, sha string")
    return ended.join(many, node, "left").select(*node, "n", "conv_id", F.coalesce("sha", F.sha2("ids", 256)).alias("ends_sha256"))


_STATE = ["k1", "k2", "depth", "n", "conv_id", "n_children", "n_leaves", "saved", "ends_sha256"]
_NOTHING = hashlib.sha256().hexdigest()


def _survivors(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth without their last turn, summed by what remains."""
    up = nodes.where(F.col("depth") == depth).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    sums = up.agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    return sums.withColumns({"depth": F.lit(depth - 1).cast("long"), "ends_sha256": F.lit(None).cast("string")}).select(*_STATE)


def _merged(state: DataFrame, *others: str) -> DataFrame:
    """Nodes of one depth: rows of the same key together, with any of their other columns, which are equal."""
    return state.groupBy("k1", "k2", "depth").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("below"), F.sum("saved").alias("saved"),
        F.coalesce(F.max("ends_sha256"), F.lit(_NOTHING)).alias("ends_sha256"), *[F.first(c).alias(c) for c in others],
    ).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("below")).cast("long"))


def _level(state: DataFrame, bottom: int, depth: int) -> DataFrame:
    """The nodes of a depth, with the keys of their block up to it."""
    at = depth - bottom
    up = lambda i, c: F.element_at("up", i)[c]
    parent = (F.col("b1"), F.col("b2")) if at == 1 else (up(at - 1, "k1"), up(at - 1, "k2"))
    return _merged(state, "up", "b1", "b2").select(
        "k1", "k2", parent[0].alias("p1"), parent[1].alias("p2"), "depth", "conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * up(at, "bytes")).alias("saved_tokens"), "ends_sha256", "up", "b1", "b2"
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth as children of what stands above them in the block."""
    none = F.lit(None).cast("string")
    return nodes.select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(depth - 1).cast("long").alias("depth"), F.col("n_convs").alias("n"), "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", F.col("saved_tokens").alias("saved"),
        none.alias("ends_sha256"), "up", "b1", "b2",
    )


def _peel(bottom: int):
    """For applyInPandas: all nodes of a band above `bottom`, from the rows of one key there."""

    def merge(live: dict, key: tuple[int, int], up: list, n: int, conv_id: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
        node = live.get(key)
        if node is None:
            live[key] = [up, n, conv_id, children, leaves, saved, ends]
            return
        node[1] += n
        node[2] = min(node[2], conv_id)
        node[3] += children
        node[4] += leaves
        node[5] += saved
        node[6] = node[6] or ends

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = (int(rows["b1"].iloc[0]), int(rows["b2"].iloc[0]))
        enter = defaultdict(list)
        for r in rows.itertuples(index=False):
            enter[int(r.depth)].append(r)
        out, live = [], {}
        for depth in range(max(enter), bottom, -1):
            for r in enter[depth]:
                up = [(int(x["k1"]), int(x["k2"]), int(x["bytes"])) for x in r.up]
                merge(live, up[-1][:2], up, int(r.n), int(r.conv_id), int(r.n_children), int(r.n_leaves), int(r.saved), r.ends_sha256)
            above: dict = {}
            for key, (up, n, conv_id, children, leaves, saved, ends) in live.items():
                parent = up[depth - bottom - 2][:2] if depth - bottom > 1 else base
                leaves, saved = leaves if children else 1, saved + (n - 1) * up[depth - bottom - 1][2]
                out.append((*key, *parent, depth, conv_id, n, children, leaves, saved, ends or _NOTHING))
                merge(above, parent, up, n, conv_id, 1, leaves, saved, None)
            live = above
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])

    return run


def _bands(ended_in: dict[int, int], narrow: int) -> list[tuple[int, int, bool]]:
    """(lowest block, highest block, whether few conversations reach it), from the top; narrow bands hold at most `narrow` pieces of conversations."""
    bands: list[tuple[int, int, bool]] = []
    alive = held = 0
    for block in range(max(ended_in, default=-1), -1, -1):
        alive += ended_in.get(block, 0)
        few = alive <= narrow
        if few and bands and bands[-1][2] and held + alive <= narrow:
            bands[-1] = (block, bands[-1][1], True)
            held += alive
        else:
            bands.append((block, block, few))
            held = alive
    return bands


def prefix_trie(conversations: DataFrame, narrow: int = 256) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    Nodes are the distinct beginnings of the conversations as rebuilt(), the
    root included, named by their smallest member and their depth. Turns are
    ordered by turn, null first, ties by role and text in byte order; repeated
    rows are turns of their own; a null role or text is empty. Rows without a
    conv_id belong to no conversation and take no part; no conversations, no
    nodes. Other columns are not read. Keys have 128 bits. Bands of at most
    `narrow` pieces of 16 turns are peeled in one step.
    """
    lengths, turns = rebuilt(conversations)
    blocks = materialize(_blocks(turns), "blocks")
    ended = materialize(_ended(lengths, blocks).withColumn("block", F.when(F.col("depth") > 0, F.expr(f"(depth - 1) div {BLOCK}")).otherwise(-1)), "ended")
    zero = F.lit(0).cast("long")
    entering = ended.select("block", "k1", "k2", "depth", "n", "conv_id", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "ends_sha256")
    found: list[DataFrame] = []
    survivors = None
    of_blocks = ended.where("block >= 0").groupBy("block").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).collect()  # a row for each 16 turns of the longest
    deepest = max((r.depth for r in of_blocks), default=0)
    for low, high, few in _bands({r.block: r.n for r in of_blocks}, narrow):
        bottom, top = low * BLOCK, min(deepest, (high + 1) * BLOCK)
        state = entering.where(F.col("block").between(low, high)).drop("block")
        state = state if survivors is None else state.unionByName(survivors)
        if few:
            of = blocks.where(F.col("block").between(low, high)).join(state.select("conv_id").distinct(), "conv_id", "left_semi")
            path = of.groupBy("conv_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("block", "up")))["up"]).alias("up"), F.min_by("b1", "block").alias("b1"), F.min_by("b2", "block").alias("b2"))
            # a conversation that goes on beyond an entering row's end is another row's business
            rows = state.join(path, "conv_id").withColumn("up", F.slice("up", F.lit(1), (F.col("depth") - bottom).cast("int")))
            nodes = materialize(rows.groupBy("b1", "b2").applyInPandas(_peel(bottom), NODE), "band")
            found.append(nodes)
        else:
            own = state.join(blocks.where(F.col("block") == low).drop("block"), "conv_id")
            own = materialize(own.withColumn("up", F.slice("up", F.lit(1), (F.col("depth") - bottom).cast("int"))), "entering")
            above = None
            for depth in range(top, bottom, -1):
                rows = own.where(F.col("depth") == depth)
                nodes = materialize(_level(rows if above is None else rows.unionByName(above), bottom, depth), "level")
                found.append(nodes)
                above = _stripped(nodes, depth)
        survivors = materialize(_survivors(nodes, bottom + 1), "survivors")
    state = entering.where("block = -1").drop("block")
    root = _merged(state if survivors is None else state.unionByName(survivors)).where("conv_id is not null")
    null = F.lit(None).cast("long")
    root = root.select("k1", "k2", null.alias("p1"), null.alias("p2"), "depth", "conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    nodes = root
    for part in found:
        nodes = nodes.unionByName(part.select(*root.columns))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["p1", "p2", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
