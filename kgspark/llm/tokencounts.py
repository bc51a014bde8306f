"""Token counts of fields or sections by offset mapping: each document is encoded once, as a whole."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "doc_id long, section long, start long, stop long, n_bytes long, n_tokens long, n_crossing long, share double"


def encoding(path: str, pattern: str):
    """A tiktoken encoding without special tokens, and the byte length of each of its ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, crossing tokens, fractional tokens) of each section; ends: where tokens end, bounds: where sections do, in bytes.

    The rule: a token that crosses a boundary counts whole for the section of
    its first byte, and as crossing there; share splits it by its bytes. Both
    sum to the number of tokens.
    """
    n = len(bounds)
    starts = np.concatenate([[0], ends[:-1]])
    first, last = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends - 1, side="right")
    whole = np.bincount(first, minlength=n)
    over = first != last
    share = np.bincount(first[~over], minlength=n).astype(float)
    crossing = np.bincount(first[over], minlength=n)
    edges = np.concatenate([[0], bounds])
    for i in np.flatnonzero(over):
        for s in range(first[i], last[i] + 1):
            share[s] += (min(ends[i], edges[s + 1]) - max(starts[i], edges[s])) / (ends[i] - starts[i])
    return whole, crossing, share


def lines(text: Column) -> Column:
    """Sections: lines, each with the line feed that ends it."""
    cut = F.split(text, "\n", -1)
    return F.transform(cut, lambda s, i: F.when(i < F.size(cut) - 1, F.concat(s, F.lit("\n"))).otherwise(s))


def section_tokens(docs: DataFrame, sections: Column, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """One row per section of each document, in bytes of its UTF-8 text: tokens by the rule of attribute().

    sections is an array of strings (lines, or fields) that make the document
    when joined. Null documents and null sections count as empty; an empty
    section has a row and no tokens; repeated rows and null ids stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, lengths = encoding(vocabulary, pattern)
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                cols: dict[str, list] = {k: [] for k in ("doc_id", "section", "start", "stop", "n_bytes", "n_tokens", "n_crossing", "share")}
                for doc_id, parts in zip(part["doc_id"], part["sections"]):
                    raw = [(p or "").encode("utf-8", "surrogatepass") for p in (parts if parts is not None else [""])]
                    size = np.array([len(r) for r in raw], dtype=np.int64)
                    bounds = np.cumsum(size)
                    ids = enc.encode_ordinary(b"".join(raw).decode("utf-8", "surrogatepass"))
                    n, over, share = attribute(np.cumsum(lengths[np.array(ids, dtype=np.int64)]), bounds) if ids else (np.zeros(len(raw), int), np.zeros(len(raw), int), np.zeros(len(raw)))
                    for k, v in (("doc_id", [doc_id] * len(raw)), ("section", range(len(raw))), ("start", bounds - size), ("stop", bounds), ("n_bytes", size), ("n_tokens", n), ("n_crossing", over), ("share", np.round(share, 6))):
                        cols[k].extend(v)
                out = pd.DataFrame(cols)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), sections.alias("sections")).mapInPandas(run, OUT)
