"""Shared pieces of the training-data operators: tables, scratch space, words, hash splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.checkpoints import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; where none is set, shared_folder() gives a local session a temporary one and raises on a cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in shared storage and read it again: lineage ends there, and lost executors only cost reads."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_split(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id written as text leaves the remainder; a null id counts as the text "" (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t..\\r; null has none. bytes.split() breaks at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """words_of() with A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words_of(text), on the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_PAGE = 1 << 15  # slots of a page


def bit_filter(slots: DataFrame, bits: int) -> Broadcast:
    """slots (slot long, 0 to bits - 1) → a broadcast filter of bits / 8 bytes, whatever the input; bits is a multiple of 1 << 15."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), _PAGE), np.uint8)
            for row, at in zip(out, b["at"]):
                row[np.asarray(at, np.int64)] = 1
            yield pd.DataFrame({"page": b["page"], "bits": [np.packbits(row, bitorder="little").tobytes() for row in out]})

    at = slots.select(F.shiftright("slot", 15).alias("page"), F.col("slot").bitwiseAND(F.lit(_PAGE - 1)).cast("int").alias("at"))
    whole = bytearray(bits // 8)
    for r in at.groupBy("page").agg(F.collect_set("at").alias("at")).mapInPandas(pack, "page long, bits binary").toLocalIterator():
        whole[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = r.bits
    return slots.sparkSession.sparkContext.broadcast(bytes(whole))


def in_filter(shared: Broadcast, slot: np.ndarray) -> np.ndarray:
    """Whether the filter holds each slot."""
    bits = np.frombuffer(shared.value, np.uint8)
    slot = slot.astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
