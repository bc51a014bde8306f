"""Concept deduplication: grouping by normalized title, fuzzy merging, canonical rows, name map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgspark.functions.fuzzy import normalize_title, similar_pairs, strip
from kgspark.sources.checkpoints import cut, stored

ORDER = ("chunk_id", "pos")


def title_frequency(mentions: DataFrame, k: int = 20) -> DataFrame:
    t = strip(F.lower("title")).alias("title")
    return mentions.groupBy(t).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(k)


def facts(mentions: DataFrame) -> DataFrame:
    """(title, definition, difficulty, aliases, n, ord): mentions with a raw title that say the same, counted, with the first of them. Tables of facts stay as they are.

    Titles, votes, definitions and names are all taken from these: one pass over the mentions.
    Rows are sorted by a hash before the texts themselves, so that most comparisons end at a number.
    """
    if "n" in mentions.columns and "ord" in mentions.columns:
        return mentions
    m = mentions.where("title is not null and title <> ''")
    if "aliases" not in mentions.columns:
        m = m.withColumn("aliases", F.array("alias"))
    says = ["title", F.coalesce("definition", F.lit("")).alias("definition"), "difficulty", "aliases"]
    key = ["title", "definition", "difficulty", "aliases"]
    rows = m.select(*says, F.struct(*ORDER).alias("ord")).withColumn("_hash", F.xxhash64(*key))
    return rows.groupBy("_hash", *key).agg(F.count("*").alias("n"), F.min("ord").alias("ord")).drop("_hash")


def normalized(mentions: DataFrame) -> DataFrame:
    """Mentions with a raw title, or facts of them, with norm and their order."""
    m = mentions.where("title is not null and title <> ''").withColumn("norm", normalize_title(F.col("title")))
    return m if "ord" in m.columns else m.withColumn("ord", F.struct(*ORDER))


def title_groups(norm: DataFrame) -> DataFrame:
    n = F.sum("n") if "n" in norm.columns else F.count("*")
    return norm.groupBy("norm").agg(n.alias("mentions"), F.min("ord").alias("first_seen"))


def leaders_of_titles(counted: DataFrame, leader_of: DataFrame) -> DataFrame:
    """(title, leader) of the raw titles of facts."""
    return normalized(counted.select("title", "n", "ord")).select("title", "norm").distinct().join(leader_of, "norm").select("title", "leader")


def _led(mentions: DataFrame, leader_of: DataFrame) -> DataFrame:
    """Mentions with their leader, by raw title where leader_of has titles, else by norm."""
    return mentions.join(leader_of, "title") if "title" in leader_of.columns else normalized(mentions).join(leader_of, "norm")


def leaders(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(norm, leader): titles in first-seen order lead unless an earlier leader is similar, and join the earliest such.

    The lexicographically first maximal independent set of the pair graph, found
    in rounds: a title leads once all earlier neighbours are absorbed, and is
    absorbed once an earlier neighbour leads. Titles without pairs lead at once.
    """
    order = groups.select("norm", "first_seen")
    e = pairs.select("a", "b").join(order.select(F.col("norm").alias("a"), F.col("first_seen").alias("fa")), "a").join(order.select(F.col("norm").alias("b"), F.col("first_seen").alias("fb")), "b")
    earlier_first = F.struct("fa", "a") < F.struct("fb", "b")
    e = cut(e.select(F.when(earlier_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(earlier_first, F.col("b")).otherwise(F.col("a")).alias("late"), F.when(earlier_first, F.col("fa")).otherwise(F.col("fb")).alias("at")))
    state = cut(e.select(F.col("early").alias("norm")).union(e.select("late")).distinct().withColumn("leads", F.lit(None).cast("boolean")))
    open_ = state.count()
    while open_:
        near = e.join(state.select(F.col("norm").alias("early"), F.col("leads").alias("early_leads")), "early")
        seen = near.groupBy(F.col("late").alias("norm")).agg(F.max(F.coalesce("early_leads", F.lit(False))).alias("hit"), F.max(F.col("early_leads").isNull()).alias("waits"))
        new = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        state = cut(state.join(seen, "norm", "left").select("norm", F.coalesce("leads", new).alias("leads")))
        left = state.where("leads is null").count()
        if left == open_:
            raise RuntimeError("no progress")
        open_ = left
    lead = state.where("leads").select(F.col("norm").alias("early"))
    absorbed = e.join(lead, "early").groupBy(F.col("late").alias("norm")).agg(F.min_by("early", F.struct("at", "early")).alias("of"))
    absorbed = absorbed.join(state.where("not leads").select("norm"), "norm", "left_semi")
    return groups.select("norm").join(absorbed, "norm", "left").select("norm", F.coalesce("of", "norm").alias("leader"))


def exact_leaders(groups: DataFrame) -> DataFrame:
    return groups.select("norm", F.col("norm").alias("leader"))


def merge_similar(mentions: DataFrame, least: float = 87.5, length_gap: int = 10) -> DataFrame:
    groups = cut(title_groups(normalized(mentions)))
    pairs = stored(similar_pairs(groups.select(F.col("norm").alias("title")), None, least, False, length_gap), "similar_titles")
    return leaders(groups, pairs)


def title_score(title) -> F.col:
    first = F.substring(title, 1, 1)
    return F.when(first != F.lower(first), 10).otherwise(0) + F.when(title.contains(" "), 5).otherwise(0) + F.length(title)


def sources_of(mentions: DataFrame, leader_of: DataFrame) -> DataFrame:
    """(leader, url): sources of each leader's mentions, each once, as rows; leader_of is (norm, leader) or (title, leader)."""
    m = mentions.where("source_url is not null and source_url <> ''")
    return _led(m, leader_of).select("leader", F.col("source_url").alias("url")).distinct()


def with_chunk_counts(concepts: DataFrame, mentions: DataFrame, leader_of: DataFrame) -> DataFrame:
    """concepts (leader, ..) with chunk_count; leader_of is (norm, leader) or (title, leader)."""
    m = _led(mentions.where("chunk_id is not null and chunk_id <> ''"), leader_of)
    chunks = m.groupBy("leader").agg(F.count_distinct("chunk_id").alias("chunk_count"))
    return concepts.join(chunks, "leader", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def canonical(mentions: DataFrame, leader_of: DataFrame, sources: bool = True, chunks: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """One row per leader: best title, longest definition, commonest difficulty, aliases, counts and, with sources, the list of sources.

    A leader's list of sources grows with its mentions: large jobs leave it out and take sources_of().

    Needs an array column aliases or a string column alias. All but sources and
    chunks comes from the facts of the mentions (`counted`, where they are at
    hand); sets are made of distinct values only.
    """
    counted = stored(facts(mentions), "facts") if counted is None else counted
    # written once: the aggregates below read it again and again
    m = stored(normalized(counted).join(leader_of, "norm").select("leader", "title", "definition", "difficulty", "aliases", "n", "ord"), "led")
    t = F.col("title")
    n_length = F.length("definition")
    main = m.groupBy("leader").agg(
        F.max_by("title", F.struct(title_score(t), t)).alias("title"),
        F.max(F.when(n_length > 0, n_length)).alias("longest"),
        F.sum("n").alias("mention_count"),
        F.min("ord").alias("first_seen"),
    )
    wanted = m.where(n_length > 0).select("leader", n_length.alias("longest"), "definition", "ord")
    definitions = wanted.join(main.select("leader", "longest"), ["leader", "longest"]).groupBy("leader").agg(F.min_by("definition", "ord").alias("definition"))
    votes = m.where("difficulty is not null and difficulty <> ''").groupBy("leader", "difficulty").agg(F.sum("n").alias("n"), F.min("ord").alias("at"))
    w = W.partitionBy("leader").orderBy(F.desc("n"), "at")
    difficulty = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("leader", "difficulty")
    names = m.select("leader", F.explode(F.concat(F.array("title"), F.filter(F.coalesce("aliases", F.array()), lambda x: x.isNotNull() & (x != "")))).alias("alias")).distinct()
    aliases = names.join(main.select("leader", "title"), "leader").where(F.lower("alias") != F.lower("title")).groupBy("leader").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    out = main.join(definitions, "leader", "left").join(difficulty, "leader", "left").join(aliases, "leader", "left")
    none = F.array().cast("array<string>")
    lists = []
    if sources:
        urls = sources_of(mentions, leaders_of_titles(counted, leader_of)).groupBy("leader").agg(F.sort_array(F.collect_list("url")).alias("source_urls"))
        out = out.join(urls, "leader", "left")
        lists = [F.coalesce("source_urls", none).alias("source_urls")]
    if chunks:
        out = with_chunk_counts(out, mentions, leaders_of_titles(counted, leader_of))
        lists.append(F.col("chunk_count"))
    return out.select(
        "leader", "title", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("difficulty", F.lit("intermediate")).alias("difficulty"), F.coalesce("aliases", none).alias("aliases"),
        "mention_count", *lists, "first_seen",
    )


def ranking(concepts: DataFrame, k: int = 20) -> DataFrame:
    return concepts.select("title", "mention_count").orderBy(F.desc("mention_count"), "title").limit(k)


def name_map(concepts: DataFrame, mentions: DataFrame, leader_of: DataFrame) -> DataFrame:
    """(name, title, first_place) of mentions or facts of them: the last writer's title and the first writing's place, writers being canonical titles, aliases, leaders and raw titles."""
    c = concepts.select("leader", "title", "aliases", "first_seen")
    group = leader_of.where("norm = leader").select("leader").join(c, "leader")
    # of the mentions of one raw title the first is enough: they write the same title
    raw = normalized(mentions).groupBy("norm", "title").agg(F.min("ord").alias("ord")).withColumnRenamed("title", "raw").join(leader_of, "norm").join(c.select("leader", "title", "first_seen"), "leader")
    zero = F.struct(F.lit("").alias("chunk_id"), F.lit(0).cast(c.schema["first_seen"].dataType["pos"].dataType).alias("pos"))
    step = lambda n, at, rank, sub: F.struct(F.lit(n).alias("stage"), at.alias("at"), F.lit(rank).alias("rank"), sub.alias("sub"))
    rows = (
        c.select(F.lower("title").alias("name"), "title", step(0, F.col("first_seen"), 0, zero).alias("place"))
        .union(c.select(F.explode("aliases").alias("alias"), "title", "first_seen").select(F.lower("alias"), "title", step(0, F.col("first_seen"), 1, zero)))
        .union(group.select("leader", "title", step(1, F.col("first_seen"), 0, zero)))
        .union(raw.select(F.lower("raw"), "title", step(1, F.col("first_seen"), 1, F.col("ord"))))
    )
    return rows.groupBy("name").agg(F.max_by("title", "place").alias("title"), F.min("place").alias("first_place"))
