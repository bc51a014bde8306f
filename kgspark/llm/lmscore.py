"""Language-model scores of whole documents: a unigram base, and a causal self-attention model.

Documents are packed into chunks of about two megabytes with their words as
places in the chunk's list of distinct words, so that each word is hashed and
tokenized once a chunk. Word counts travel as arrays of hashes, by hash bucket;
model parameters are trained in each task, on every training document, and
averaged between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.attention import Vocabulary, inputs, log_probabilities, start, start_from_pairs, train, vocabulary
from kgspark.llm.common import materialize
from kgspark.llm.tokenids import WordEncoder, distinct_words, runs

CHUNK = "chunk long, n_train long, docs binary, words binary, hashes binary, pieces binary"
CHUNK_BYTES = 2 << 20
REMEMBER = 200_000  # words whose ids a Python worker keeps; a memory bound, not a cut
LOG10 = np.log(10)
NONE = 0xFFFFFFFF  # first id of a word without ids


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of one row each, one after another, compressed."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unzip(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(raw[at : at + n], kind))
        at += n
    return out


def chunks(docs: DataFrame, held_out: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed into chunks; a chunk's number follows from its partition and place, and is fixed once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made, part = WordEncoder.of_worker(tokenizer_path, remember=REMEMBER), 0, TaskContext.get().partitionId()

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            ids, texts, held = (rows.column(n).combine_chunks() for n in ("doc_id", "text", "held"))
            words, places, lengths = distinct_words(texts, lower=True)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], dtype="<u8")
            sizes, pieces = encoder.pieces(words)
            held = pc.fill_null(held, False).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            flat = pc.fill_null(ids, 0).to_numpy()
            out = {
                "chunk": [(part << 32) + made], "n_train": [int((~held).sum())],
                "docs": [_zip(flat.astype("<i8"), known.astype("u1"), held.astype("u1"), lengths.astype("<i8"))],
                "words": [_zip(places.astype("<u4"))],
                "hashes": [hashes.tobytes()],
                "pieces": [_zip(sizes.astype("<u4"), pieces)],
            }
            made += 1
            return pa.RecordBatch.from_pydict(out, pa.schema([("chunk", pa.int64()), ("n_train", pa.int64()), *((n, pa.binary()) for n in ("docs", "words", "hashes", "pieces"))]))

        rest = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            cuts = list(runs(rows.column("text").combine_chunks(), CHUNK_BYTES))
            for x, y in cuts[:-1]:
                yield packed(rows[x:y])
            rest = rows[cuts[-1][0] :] if cuts else rows
        if rest is not None and rest.num_rows:
            yield packed(rest)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held")).mapInArrow(run, CHUNK)


def release() -> None:
    """Words remembered, and memory that Arrow keeps, are of no more use to a worker once chunks are made."""
    WordEncoder.of_worker.cache_clear()
    pa.default_memory_pool().release_unused()


class Chunk:
    def __init__(self, docs: bytes, words: bytes) -> None:
        self.ids, self.known, self.held, self.lengths = _unzip(docs, "<i8", "u1", "u1", "<i8")
        (self.words,) = _unzip(words, "<u4")
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def training_words(self) -> np.ndarray:
        return self.words[np.repeat(self.held == 0, self.lengths)]

    def pieces(self, packed: bytes, end: int, which: np.ndarray) -> Pieces:
        """Subword ids of the chosen documents, each with its end id."""
        sizes, flat = _unzip(packed, "<u4", "<u4")
        sizes = sizes.astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        which = np.flatnonzero(which)
        words = self.words[np.concatenate([np.arange(self.starts[d], self.ends[d]) for d in which])] if len(which) else np.zeros(0, "<u4")
        n = sizes[words]
        before = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(before, n)
        body = flat[np.repeat(begin[words], n) + inside].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        words_upto = np.cumsum(self.lengths[which])
        doc_ends = upto[words_upto] if len(which) else np.zeros(0, np.int64)
        ids, kinds = np.insert(body, doc_ends, end), np.insert((inside > 0).astype(np.int64), doc_ends, 0)
        ends = doc_ends + np.arange(1, len(which) + 1)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(which) else ends
        # each word's first piece, moved on by the end ids of the documents before its own
        first = before + np.repeat(np.arange(len(which)), self.lengths[which])
        return Pieces(ids, kinds, starts, ends, words, first, n, self.lengths[which])


@dataclass
class Pieces:
    """ids and their kinds (0: a word or the end starts, 1: a word goes on), documents as ranges, and per word: its place among distinct words, its first id, its ids; lengths: words of each document."""

    ids: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    first: np.ndarray
    n: np.ndarray
    lengths: np.ndarray


def _requests(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                c, hashes = Chunk(r.docs, r.words), np.frombuffer(r.hashes, "<u8")
                counts = np.bincount(c.training_words(), minlength=len(hashes)).astype("<i8")
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                sizes, flat = _unzip(r.pieces, "<u4", "<u4")
                first = np.full(len(sizes), NONE, "<u4")
                first[sizes > 0] = flat[(np.cumsum(sizes, dtype=np.int64) - sizes)[sizes > 0]]
                rows = [(k, r.chunk, hashes[order[x:y]].tobytes(), _zip(counts[order[x:y]]), _zip(first[order[x:y]])) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "chunk", "hashes", "counts", "firsts"])

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a bucket's words, returned to each chunk in the order it asked; under chunk -1, how many distinct ones begin with which id."""
    hashes = np.frombuffer(b"".join(rows["hashes"]), "<u8")
    counts = np.concatenate([_unzip(c, "<i8")[0] for c in rows["counts"]])
    words, where, place = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, place, counts)
    cut = np.cumsum([len(h) // 8 for h in rows["hashes"]])[:-1]
    answers = [_zip(a.astype("<i8")) for a in np.split(total[place], cut)]
    firsts = np.concatenate([_unzip(f, "<u4")[0] for f in rows["firsts"]])[where][total > 0]
    ids, n = np.unique(firsts, return_counts=True)
    return pd.DataFrame(
        {"chunk": [*rows["chunk"], -1], "bucket": rows["bucket"].iloc[0], "counts": [*answers, np.array([ids, n], dtype="<i8").tobytes()], "distinct": [0] * len(rows) + [int((total > 0).sum())]}
    )


def first_words(answers: DataFrame, vocabulary_size: int) -> np.ndarray:
    """Distinct training words by their first id; of vocabulary size, whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["counts"]:
                ids, n = np.frombuffer(c, "<i8").reshape(2, -1)
                yield pd.DataFrame({"id": ids, "n": n})

    out = np.zeros(vocabulary_size + 1)
    for r in answers.where("chunk = -1").select("counts").mapInPandas(run, "id long, n long").where(F.col("id") < vocabulary_size).groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def piece_counts(packed: DataFrame, vocabulary_size: int, ends: int) -> np.ndarray:
    """counts[kind, id] of all ids in the training documents, and in a third row those that end a word; the sums are of vocabulary size, whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, vocabulary_size + 1), np.int64)
        for b in batches:
            for r in b.itertuples(index=False):
                sizes, flat = _unzip(r.pieces, "<u4", "<u4")
                n = np.bincount(Chunk(r.docs, r.words).training_words(), minlength=len(sizes))
                begin, some = np.cumsum(sizes) - sizes, sizes > 0
                every = np.bincount(flat, np.repeat(n, sizes), vocabulary_size + 1).astype(np.int64)
                first = np.bincount(flat[begin[some].astype(np.int64)], n[some], vocabulary_size + 1).astype(np.int64)
                last = np.bincount(flat[(begin + sizes - 1)[some].astype(np.int64)], n[some], vocabulary_size + 1).astype(np.int64)
                total += np.array([first, every - first, last])
        kind, at = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "id": at, "n": total[kind, at]})

    rows = packed.select("docs", "words", "pieces").mapInPandas(run, "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((3, vocabulary_size + 1))
    for r in rows:
        out[r.kind, r.id] = r.n
    out[0, vocabulary_size] = ends
    return out


def pair_counts(packed: DataFrame, vocab: Vocabulary, end: int) -> np.ndarray:
    """counts[kind, embedding row before, class]: over all training documents, of the model's dimensions whatever the corpus."""
    shape = (2, vocab.rows, vocab.groups)
    shared = packed.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, total = shared.value, np.zeros(shape, np.int64).reshape(-1)
        for b in batches:
            for r in b.itertuples(index=False):
                c = Chunk(r.docs, r.words)
                x = c.pieces(r.pieces, end, c.held == 0)
                if len(x.ids):
                    total += np.bincount((x.kinds * vocab.rows + inputs(vocab, x.ids, x.starts)) * vocab.groups + vocab.group[x.ids], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    def packed_sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [rows["at"].to_numpy("<i8").tobytes()], "n": [rows["n"].to_numpy("<i8").tobytes()]})

    summed = packed.select("docs", "words", "pieces").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(shape).reshape(-1)
    # at most 2 x rows x classes counts, 16 arrays of them
    for r in summed.groupBy(F.pmod("at", F.lit(16))).applyInPandas(packed_sum, "at binary, n binary").collect():
        out[np.frombuffer(r["at"], "<i8")] = np.frombuffer(r["n"], "<i8")
    return out.reshape(shape)


def text_scores(lp: np.ndarray, pieces: Pieces, counts: np.ndarray, first_counts: np.ndarray, first_distinct: np.ndarray, stop: np.ndarray, plain: np.ndarray, plain_end: float, trust: float) -> np.ndarray:
    """Natural log probability of each text from those of its ids.

    Each word, and the end, is drawn with chance `trust` by attention, else by
    the unigram base (plain: natural log probabilities of the distinct words).
    Attention draws a word's first id; given that, with chance F/(F+D) the word
    is one of those that training saw with this first id, by their counts (F of
    them, D distinct: Witten and Bell's rule), else it comes id by id, by
    attention, ending after each with that id's chance in stop.
    """
    total = np.zeros(len(pieces.starts))
    upto, on = np.concatenate([[0.0], np.cumsum(lp)]), np.concatenate([[0.0], np.cumsum(np.log1p(-stop[pieces.ids]))])
    some = pieces.n > 0
    at, n = pieces.first[some], pieces.n[some]
    rest = upto[at + n] - upto[at + 1] + on[at + n - 1] - on[at] + np.log(stop[pieces.ids[at + n - 1]])
    seen, of_first, kinds = counts[pieces.words[some]], first_counts[pieces.ids[at]], first_distinct[pieces.ids[at]]
    with np.errstate(divide="ignore"):
        known = np.log(seen / np.maximum(of_first + kinds, 1))
        fresh = np.where(of_first > 0, np.log(kinds / np.maximum(of_first + kinds, 1)), 0.0) + rest
    a, b = np.log(trust), np.log(1 - trust)
    word = np.logaddexp(a + lp[at] + np.logaddexp(known, fresh), b + plain[pieces.words[some]])
    np.add.at(total, np.searchsorted(pieces.ends, at, side="right"), word)
    # words that the tokenizer gives no ids are the base's alone
    bare = np.repeat(np.arange(len(pieces.lengths)), pieces.lengths)[~some]
    np.add.at(total, bare, b + plain[pieces.words[~some]])
    return total + np.logaddexp(a + lp[pieces.ends - 1], b + plain_end)


def fit(packed: DataFrame, vocab: Vocabulary, end: int, rounds: int, rate: float) -> dict[str, np.ndarray]:
    """Parameters after `rounds` of training in every task from common parameters, averaged by ids seen.

    Round r takes the training documents whose place in their chunk leaves r
    modulo `rounds`, so that each of them is trained on once.
    """
    spark = packed.sparkSession
    p = start_from_pairs(start(vocab), vocab, pair_counts(packed, vocab, end))
    names = sorted(p)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((p, vocab))

        def run(batches: Iterator[pd.DataFrame], k=k, shared=shared) -> Iterator[pd.DataFrame]:
            release()
            p, vocab = shared.value
            p = {n: v.copy() for n, v in p.items()}
            seen = 0
            for b in batches:
                for r in b.itertuples(index=False):
                    c = Chunk(r.docs, r.words)
                    chosen = (c.held == 0) & ((np.cumsum(c.held == 0) + int(r.chunk)) % rounds == k)
                    x = c.pieces(r.pieces, end, chosen)
                    if len(x.ids):
                        seen += train(p, vocab, x.ids, x.kinds, x.starts, x.ends, rate / (1 + k))
            if seen:
                yield pd.DataFrame({"name": names, "seen": seen, "values": [p[n].astype("<f4").tobytes() for n in names]})

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(s * np.frombuffer(v, "<f4").astype(float) for s, v in zip(rows["seen"], rows["values"]))
            return pd.DataFrame({"name": [rows["name"].iloc[0]], "part": [0], "seen": [int(rows["seen"].sum())], "values": [(total / rows["seen"].sum()).astype("<f4").tobytes()]})

        # means of at most 16 tasks first, then of those
        once = packed.select("chunk", "docs", "words", "pieces").mapInPandas(run, "name string, seen long, values binary").withColumn("part", F.pmod(F.xxhash64("values"), F.lit(16)).cast("int"))
        some = once.groupBy("name", "part").applyInPandas(average, "name string, part int, seen long, values binary")
        done = {r.name: np.frombuffer(r["values"], "<f4").reshape(p[r.name].shape).copy() for r in some.groupBy("name").applyInPandas(average, "name string, part int, seen long, values binary").collect()}
        p = done or p
    return p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    docs: DataFrame, held_out: Column, tokenizer_path: str, vocabulary_size: int = 49_408, rounds: int = 4, rate: float = 0.004, trust: float = 0.75, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Tokens of the base are lower-cased (A-Z) words and one end; its score sums
    log10((c+1)/(N+1*(V+1))) over training counts c. score is the log10
    probability of the same words and the end under the attention model on their
    subword ids, mixed word by word with the base (see text_scores).
    Counts and gradients cover all training documents. Null and empty texts
    have the end alone; without training documents N and V are 0 and the model
    is untrained; repeated rows count each; null ids stay null.
    """
    spark = docs.sparkSession
    packed = materialize(chunks(docs, held_out, tokenizer_path, id_col, text_col), "chunks", codec="none")
    size = packed.agg(F.sum(F.length("hashes")), F.sum("n_train"), F.count("*")).first()
    buckets, n_train = int((size[0] or 0) // bucket_bytes) + 8, int(size[1] or 0)
    asked = packed.select("chunk", "docs", "words", "hashes", "pieces").mapInPandas(_requests(buckets), "bucket long, chunk long, hashes binary, counts binary, firsts binary")
    answers = materialize(asked.groupBy("bucket").applyInPandas(_answer, "chunk long, bucket long, counts binary, distinct long"), "counts")
    distinct = int(answers.agg(F.sum("distinct")).first()[0] or 0) + (n_train > 0)
    counts = piece_counts(packed, vocabulary_size, n_train)
    vocab = vocabulary(counts[:2])
    end = vocabulary_size
    p = fit(packed, vocab, end, rounds, rate)
    whole = counts[:2].sum(axis=0)
    # each id's share of word ends, drawn a little towards that of all ids
    stop = (counts[2] + 0.02 * (counts[2].sum() + 1) / (whole.sum() + 2)) / (whole + 0.02)
    stop = np.clip(stop, 1e-9, 1 - 1e-9)

    def words_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [sum(int(Chunk(d, w).training_words().size) for d, w in zip(b["docs"], b["words"]))]})

    n = int(packed.select("docs", "words").mapInPandas(words_in, "n long").agg(F.sum("n")).first()[0] or 0) + n_train
    shared = spark.sparkContext.broadcast((p, vocab, counts[0], first_words(answers, vocabulary_size), stop))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        p, vocab, first_counts, first_distinct, stop = shared.value
        for b in batches:
            for r in b.itertuples(index=False):
                c, hashes = Chunk(r.docs, r.words), np.frombuffer(r.hashes, "<u8")
                order = np.argsort((hashes % np.uint64(buckets)).astype(np.int64), kind="stable")
                count = np.zeros(len(hashes), np.int64)
                if len(hashes):
                    count[order] = np.concatenate([_unzip(x["counts"], "<i8")[0] for x in sorted(r.answers, key=lambda x: x["bucket"])])
                whole = np.log10(n + distinct + 1.0)
                each = np.log10(count + 1.0) - whole
                of = np.repeat(np.arange(len(c.ids)), c.lengths)
                base = np.bincount(of, each[c.words], len(c.ids)) + np.log10(n_train + 1.0) - whole
                known = np.bincount(of, count[c.words] > 0, len(c.ids)).astype(np.int64) + (n_train > 0)
                x = c.pieces(r.pieces, end, np.ones(len(c.ids), bool))
                lp = log_probabilities(p, vocab, x.ids, x.kinds, x.starts, x.ends)
                doc = pd.array(c.ids, dtype="Int64")
                doc[c.known == 0] = pd.NA
                yield pd.DataFrame(
                    {"doc_id": doc, "held_out": c.held > 0, "n_tokens": c.lengths + 1, "n_known": known, "train_tokens": n, "base_score": base, "score": text_scores(lp, x, count, first_counts, first_distinct, stop, each * LOG10, (np.log10(n_train + 1.0) - whole) * LOG10, trust) / LOG10}
                )

    by_chunk = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    return packed.join(by_chunk, "chunk", "left").mapInPandas(run, SCORES)
