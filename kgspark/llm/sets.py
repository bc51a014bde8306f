"""Sets of word shingles, their minima and bands, and what their exact comparison needs: texts asked for, rows run by run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import bit_filter, in_filter, lower_words

_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Hash of each run of `shingle` words, in order; of all words where there are fewer."""
    words = lower_words(text)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash64(b" ".join(words), seed)] if words else [], dtype="<u8")
    whole, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([hash64(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def minima(h: np.ndarray, by: np.ndarray, block: int = 256) -> np.ndarray:
    """For each multiplier the least product with a hash, modulo 2^64."""
    out = np.full(len(by), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), block):
            np.minimum(out, (h[i : i + block, None] * by).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One key for each run of `rows` minima."""
    keys = np.zeros(len(least) // rows, np.uint64)
    for j in range(rows):
        keys = mixed(keys ^ least[j::rows])
    return keys.view(np.int64)


def with_texts(wanted: DataFrame, rows: DataFrame, bits: int = 1 << 27) -> DataFrame:
    """wanted (v, …) with the text of row v. Texts that nobody asks for are told by a filter of fixed size and not shuffled."""
    # row numbers have their partition in the upper 31 bits
    slot = lambda part, at: part * 1_000_003 + at
    low = (1 << 33) - 1
    asked = bit_filter(wanted.select(F.pmod(slot(F.shiftright("v", 33), F.col("v").bitwiseAND(F.lit(low))), F.lit(bits)).alias("slot")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy()
            kept = b.filter(pa.array(in_filter(asked, slot(v >> 33, v & low) % bits)))
            if kept.num_rows:
                yield kept

    return wanted.join(rows.select(F.col("row").alias("v"), "text").mapInArrow(run, "v long, text string"), "v")


def runs(key: list[str], work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]):
    """For mapInPandas: sorted rows, run by run of equal keys; only one run is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            new = (b[key] != b[key].shift()).any(axis=1).to_numpy()
            if held and (b[key].iloc[0] == held[-1][key].iloc[-1]).all():
                new[0] = False
            elif held:
                yield from work(pd.concat(held))
                held = []
            starts = [0, *[i for i in np.flatnonzero(new).tolist() if i], len(b)]
            for a, z in zip(starts, starts[1:]):
                if a and held:
                    yield from work(pd.concat(held))
                    held = []
                held.append(b.iloc[a:z])
        if held:
            yield from work(pd.concat(held))

    return run
