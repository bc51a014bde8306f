"""Phrase collocations from count streams in prefix and suffix order.

Texts become chunks of word numbers once. Words, pairs and triples are counted
from them in three passes, each over what the one before left possible: a
phrase occurs no more often than any part of it. The frequent ones form one
stream. Sorted by first words, a phrase's beginnings stand before it; sorted
by last words, its endings do. One scan of each order, in lockstep over words,
pairs and triples, therefore meets every left, right and extension count
without a hash table.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import bit_filter, in_filter, materialize

BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")


class _Numbers(dict):
    """Words by number in order of appearance; 0 is the end of a piece, written "." as no word holds it."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, with a 0 after each piece."""
    found = (text or b"").lower().translate(_TABLE).replace(b"\n", b" . ").split()
    out = np.zeros(len(found) + 1, np.int32)
    out[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
    return out


def _chunks(docs: DataFrame, chunk_bytes: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, words, ids, n): runs of texts of one language, their words joined by spaces and the numbers of these."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def close(held: dict[str, tuple[_Numbers, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, (numbers, parts) in held.items():
            ids = np.concatenate(parts)
            row = [[lang], [b" ".join(list(numbers)[1:])], [ids.tobytes()], [int(np.count_nonzero(ids))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["lang", "words", "ids", "n"])
        held.clear()
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0
        for b in batches:
            for lang, value in zip(b.column(0).to_pylist(), b.column(1)):
                text = value.as_py()
                numbers, parts = held.setdefault(lang, (_Numbers(), []))
                parts.append(numbered(text, numbers))
                size += len(text or b"") + 64
                if size >= chunk_bytes:
                    yield from close(held)
                    size = 0
        yield from close(held)

    return narrow.mapInArrow(run, "lang string, words binary, ids binary, n long")


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head, digest = lang.encode() + b" ", xxhash.xxh64_intdigest
    return np.fromiter((digest(head + w) for w in words), np.uint64, len(words))


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _holds(shared: Broadcast, h: np.ndarray) -> np.ndarray:
    return in_filter(shared, h % np.uint64(8 * len(shared.value)))


def _filter(frequent: DataFrame, bits: int) -> Broadcast:
    """A filter of fixed size that holds every phrase of the stream, and some others: it saves work and decides nothing."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, rows in b.groupby("lang", sort=False):
                h = _word_hashes(lang, list(rows["w1"]))
                if not rows["w2"].isna().all():
                    h = _pair_hashes(h, _word_hashes(lang, list(rows["w2"])))
                yield pd.DataFrame({"slot": np.unique(h % np.uint64(bits)).astype(np.int64)})

    return bit_filter(frequent.mapInPandas(slots, "slot long"), bits)


def _count(chunks: DataFrame, order: int, least: int, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """(lang, w1, w2, w3, c) of the phrases of `order` words that occur at least `least` times."""

    def rows(lang: str, vocabulary: pa.Array, columns: list[np.ndarray], c: np.ndarray, step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(c), step):
            # one short key a row: the words, which hold no space, and then the language
            own = [vocabulary.take(pa.array(x[i : i + step])) for x in columns]
            key = pc.binary_join_element_wise(*own, pa.scalar(lang.encode(), pa.binary()), pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays([key, pa.array(c[i : i + step], pa.int64())], names=["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lang, ids = b.column(0)[i].as_py(), np.frombuffer(b.column(2)[i].as_py(), np.int32)
                names = [b".", *b.column(1)[i].as_py().split(b" ")]
                vocabulary, v = pa.array(names, pa.binary()), np.int64(len(names))
                if order == 1:
                    c = np.bincount(ids, minlength=v)
                    at = np.flatnonzero(c[1:]) + 1
                    yield from rows(lang, vocabulary, [at], c[at])
                    continue
                hashes = _word_hashes(lang, names)
                known = _holds(words, hashes)
                known[0] = False
                ids = np.where(known[ids], ids, 0)
                start = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                both = ids[start] * v + ids[start + 1]
                if order == 2:
                    key, c = np.unique(both, return_counts=True)
                    yield from rows(lang, vocabulary, [key // v, key % v], c)
                    continue
                key, of = np.unique(both, return_inverse=True)
                a, z = key // v, key % v
                pair = np.full(len(ids), -1, np.int64)
                pair[start] = np.where(_holds(pairs, _pair_hashes(hashes[a], hashes[z])), np.arange(len(key)), -1)[of]
                start = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
                key, c = np.unique(pair[start] * v + ids[start + 2], return_counts=True)
                yield from rows(lang, vocabulary, [a[key // v], z[key // v], key % v], c)
            pa.default_memory_pool().release_unused()

    counted = chunks.select("lang", "words", "ids").mapInArrow(run, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    text = F.col("key").cast("string")
    words_only = F.substring_index(text, " ", order)
    word = lambda i: F.substring_index(F.substring_index(words_only, " ", i), " ", -1) if i <= order else F.lit(None)
    lang = F.substr(text, F.length(words_only) + 2)
    return counted.select(lang.alias("lang"), *[word(i).cast("binary").alias(f"w{i}") for i in (1, 2, 3)], "c")


def _in_order(stream: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The stream cut into `parts` ranges of its order, each with copies of the rows that begin its phrases.

    A word or pair whose phrases reach over several ranges stands at the head
    of each, so that a range is scanned alone, however many phrases begin with
    one word. `own` marks a row's first place.
    """
    order = ["lang", *keys]
    share = min(1.0, 64 * parts / max(1, stream.count()))
    some = sorted((r[0].encode(), *(bytes(x or b"") for x in r[1:])) for r in stream.select(order).sample(fraction=share, seed=42).collect())  # about 64 rows a range
    bounds = some[:: max(1, len(some) // parts)][1:]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = [], []
            for k in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in order)):
                own = (k[0].encode(), *(x or b"" for x in k[1:]))
                first.append(p := bisect.bisect_right(bounds, own))
                # all that begins with these words: up to the first bound beyond
                n = 4 if k[3] is not None else 3 if k[2] is not None else 2
                last.append(p if n == 4 else bisect.bisect_right(bounds, own[:n], lo=p, key=lambda x, n=n: x[:n]))
            yield b.append_column("first", pa.array(first, pa.int32())).append_column("last", pa.array(last, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    placed = stream.mapInArrow(place, f"{schema}, first int, last int").withColumn("part", F.explode(F.sequence("first", "last")))
    placed = placed.withColumn("own", F.col("part") == F.col("first")).drop("first", "last")
    return placed.repartitionByRange(parts, "part").sortWithinPartitions("part", *order)


def _lockstep(stream: DataFrame, keys: list[str], one: str, two: str, parts: int) -> DataFrame:
    """The stream with, of each phrase, the counts of its first word (one) and, where it has three, of its first two (two), first in the order of keys."""
    given = stream.columns

    def filled(c: np.ndarray, here: np.ndarray, before: int) -> np.ndarray:
        at = np.maximum.accumulate(np.where(here, np.arange(len(c)), -1))
        return np.where(at < 0, before, c[at])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f1 = f2 = np.zeros(1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            c = column("c").to_numpy(zero_copy_only=False)
            n = 3 - column(keys[1]).is_null().to_numpy(zero_copy_only=False) - column(keys[2]).is_null().to_numpy(zero_copy_only=False).astype(np.int8)
            f1, f2 = filled(c, n == 1, f1[-1]), filled(c, n == 2, f2[-1])
            out = pa.RecordBatch.from_arrays([*(column(x) for x in given), pa.array(f1), pa.array(f2, mask=n < 3)], names=[*given, one, two])
            yield out.filter(column("own"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return _in_order(stream, keys, parts).mapInArrow(scan, f"{schema}, {one} long, {two} long")


def collocations(
    docs: DataFrame, least: int = 10, cover_percent: int = 50, per_lang: int = 2000, chunk_bytes: int = 1 << 22, filter_bits: int = 1 << 26, salts: int = 32, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 or 3 words of each language.

    a counts the phrase (at least `least`), l and r the two parts of the cut
    with the lowest floor(1000000 a a / (l r)), the first such cut; n all words
    of the language. A phrase inside a longer candidate with at least
    cover_percent of its count is left out. Ties go to the greater a, then to
    the phrase in byte order. Null texts are empty, a null language is "und";
    repeated rows count again, ids and other columns are not read, an empty
    table has no phrases. A text stays whole, a chunk takes chunk_bytes or one
    text; filters take filter_bits whatever the input, and only save work.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = materialize(_chunks(docs, chunk_bytes, lang_col, text_col), "chunks")
    words = materialize(_count(chunks, 1, least), "words")
    known_words = _filter(words, filter_bits)
    pairs = materialize(_count(chunks, 2, least, known_words), "pairs")
    known_pairs = _filter(pairs, filter_bits)
    triples = materialize(_count(chunks, 3, least, known_words, known_pairs), "triples")
    known_words.destroy()
    known_pairs.destroy()
    stream = words.unionByName(pairs).unionByName(triples)
    stream = materialize(_lockstep(stream, ["w1", "w2", "w3"], "l1", "l2", parts), "prefix_order")
    # in suffix order words are read from the last
    back = stream.withColumn("z1", F.coalesce("w3", "w2", "w1")).withColumn("z2", F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1"))).withColumn("z3", F.when(F.col("w3").isNotNull(), F.col("w1")))
    both = materialize(_lockstep(back, ["z1", "z2", "z3"], "r1", "r2", parts).drop("z1", "z2", "z3"), "suffix_order")

    longer = both.where("w3 is not null")
    covers = lambda part: F.col("c").cast("decimal(38,0)") * 100 >= F.col(part).cast("decimal(38,0)") * cover_percent
    inside = longer.where(covers("l2")).select("lang", "w1", "w2").unionByName(longer.where(covers("r2")).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))).distinct()
    two = both.where("w2 is not null and w3 is null").join(inside.hint("merge"), ["lang", "w1", "w2"], "left_anti").unionByName(longer)

    wide = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    cut = lambda k, left, right: F.struct(F.expr(f"cast(1000000 as decimal(38,0)) * _a * _a div (_{left} * _{right})").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    cuts = two.withColumns({f"_{c}": wide(c) for c in ("l1", "l2", "r1", "r2")} | {"_a": wide("c")})
    cuts = cuts.withColumn("cut", F.when(F.col("w3").isNull(), cut(1, "l1", "r1")).otherwise(F.least(cut(1, "l1", "r2"), cut(2, "l2", "r1"))))
    phrase = F.concat_ws(" ", *[F.col(w).cast("string") for w in ("w1", "w2", "w3")])
    scored = cuts.select("lang", phrase.alias("phrase"), F.col("c").alias("a"), "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("at") <= per_lang)
    # per_lang * salts rows of a language at most
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= per_lang)
    n = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
