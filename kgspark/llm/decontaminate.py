"""Benchmark decontamination by greedy string tiling (running Karp-Rabin)."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import lower_words

BASE = np.uint64(0x9E3779B97F4A7C15)
EDGE = b".,;:!?\"'()[]{}|*%&$#<>-"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [t for w in lower_words(text) if (t := w.strip(EDGE))]


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2^64 for i below size."""
    out = []
    for base in (int(BASE), _inverse(int(BASE))):
        p = np.full(size, base, dtype=np.uint64)
        p[:1] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin value of each window of n ids, modulo 2^64: a running sum of ids times powers of BASE, moved to the window's place."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << max(10, len(ids).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(ids.astype(np.uint64) * up[: len(ids)], out=sums[1:])
        return (sums[n:] - sums[:-n]) * down[: len(ids) - n + 1]


def _free(ids: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """Starts of windows of n ids that are unmarked; ids of 0 or less never match."""
    stop = np.concatenate([[0], np.cumsum(used | (ids <= 0))])
    return np.flatnonzero(stop[n:] == stop[: len(stop) - n]) if len(ids) >= n else np.zeros(0, np.int64)


def tile(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length) in the order marked, longest first, earliest on ties.

    Each search length, from long to `least`, finds the runs that begin with
    equal windows by running Karp-Rabin, verified id by id. They are marked
    longest first; of a run that is partly marked by then, its free parts wait
    their turn, so that each tile is the longest unmarked run there is.
    """
    a, b = np.asarray(pattern, dtype=np.int64), np.asarray(text, dtype=np.int64)
    mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(40, len(a)))
    while True:
        places: dict[int, list[int]] = defaultdict(list)
        at = _free(b, mark_b, search)
        for t, h in zip(at.tolist(), rolling(b, search)[at].tolist() if len(at) else []):
            places[h].append(t)
        at = _free(a, mark_a, search) if places else []
        found: list[tuple[int, int, int]] = []
        for p, h in zip(at.tolist() if len(at) else [], rolling(a, search)[at].tolist() if len(at) else []):
            for t in places.get(h, ()):
                free = p and t and pattern[p - 1] == text[t - 1] and pattern[p - 1] > 0 and not mark_a[p - 1] and not mark_b[t - 1]
                if free or pattern[p : p + search] != text[t : t + search]:
                    continue  # not where its run begins, or not equal
                k = search
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and pattern[p + k] > 0 and not mark_a[p + k] and not mark_b[t + k]:
                    k += 1
                found.append((-k, p, t))
        heapq.heapify(found)
        while found:
            k, p, t = heapq.heappop(found)
            marked = mark_a[p : p - k] | mark_b[t : t - k]
            if not marked.any():
                mark_a[p : p - k] = mark_b[t : t - k] = True
                tiles.append((p, t, -k))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if y - x >= search:
                    heapq.heappush(found, (x - y, p + x, t + x))
        if search == least:
            return tiles
        search = max(least, search // 2)


class Bench:
    """Seeds of a block of benchmark items: hashes of their windows, with items and places."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, threshold: float) -> None:
        self.least, self.threshold = least, threshold
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in tokens(text)]
            if not words:
                continue
            n = min(least, len(words))
            k = len(self.items)
            self.items.append((item_id, words, n))
            for at, h in enumerate(rolling(np.array(words), n)):
                seeds[n].append((int(h), k, at))
        self.seeds = {n: self._table(rows) for n, rows in seeds.items()}

    @staticmethod
    def _table(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for h, k, at in rows:
            by[h].append((k, at))
        return np.array(sorted(by), dtype=np.uint64), by

    def match(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, item words, matched words, tiles) of the items whose coverage reaches the threshold."""
        get = self.ids.get
        words = np.fromiter((get(w, 0) for w in tokens(text)), dtype=np.int64)
        if not words.any():
            return []
        covered: dict[int, tuple[set[int], set[int]]] = {}
        for n, (known, by) in self.seeds.items():
            h = rolling(words, n)
            if not len(h):
                continue
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == h)
            hit = hit[[bool((words[i : i + n] > 0).all()) for i in hit]] if len(hit) else hit
            for i in hit:
                for k, p in by[int(h[i])]:
                    a, b = covered.setdefault(k, (set(), set()))
                    a.update(range(p, p + n))
                    b.update(range(int(i), int(i) + n))
        out = []
        for k, (in_item, in_text) in covered.items():
            item_id, item, n = self.items[k]
            if len(in_item) < self.threshold * len(item):  # no tiling covers more than its seeds
                continue
            places = sorted(in_text)
            part: list[int] = []
            for j, i in enumerate(places):
                if j and i != places[j - 1] + 1:
                    part.append(0)
                part.append(int(words[i]))
            tiles = tile(item, part, n)
            matched = sum(t[2] for t in tiles)
            if matched >= self.threshold * len(item):
                out.append((item_id, len(item), matched, len(tiles)))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The items in broadcast blocks of about block_bytes; one block at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).orderBy("item_id", "item_text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.item_text) for r in rows])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, tiles, coverage): pairs whose tiles cover `threshold` of the item.

    Tiles are runs of at least `least` equal words (items with fewer words:
    the whole item), so reordered passages count in full. Words are compared
    without case (A-Z) and without punctuation at their ends. The benchmark
    goes to the tasks in blocks of block_bytes, each with its own pass over the
    documents, however large it is; documents are not shuffled. Null, empty and
    wordless texts and items match nothing; repeated rows give repeated pairs;
    null ids stay null.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for shared in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            bench = Bench(shared.value, least, threshold)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in bench.match(t)]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "item_words", "matched_words", "tiles"]).astype("Int64")

        part = narrow.mapInPandas(run, "doc_id long, item_id long, item_words long, matched_words long, tiles long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text contaminated() pairs with no item, whatever their ids; all columns, no shuffle."""
    for shared in _blocks(benchmark, block_bytes):

        def run(batches, shared=shared):
            import pyarrow as pa

            bench = Bench(shared.value, least, threshold)
            for b in batches:
                yield b.filter(pa.array([not bench.match(t) for t in b.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
