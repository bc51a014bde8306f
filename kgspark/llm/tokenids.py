"""Token ids as files: encode documents, write range-coded blocks in id order, read them back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm.common import materialize, scratch
from kgspark.llm.rangecoder import BLOCK, LANES, decode_blocks, encode_blocks

REMEMBER = 1_000_000  # words whose ids a Python worker keeps at once; a memory bound, not a cut
RUN = 16 << 20  # bytes of text whose words are split at once
LETTERS = "".join(chr(c) for c in range(0x100) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 and c not in (0xD7, 0xF7))  # of ASCII and of the first Unicode block after it
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\"  # ASCII that a word may end in without changing how the letters before it are cut


class WordEncoder:
    """Ids of words from a tokenizer whose pieces never cross white space and that ignores case; each new word is encoded once.

    A word of letters and closing punctuation is two pieces to such a
    tokenizer, so that its ids are those of its letters, in lower case, and of
    its punctuation; these are what is remembered.
    """

    def __init__(self, path: str, narrow: bool = False, remember: int = REMEMBER) -> None:
        """narrow: ids take 16 bits each where the vocabulary allows it, else 32."""
        from tokenizers import Tokenizer

        self.remember = remember

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if narrow and self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def of_worker(cls, path: str, narrow: bool = False, remember: int = REMEMBER) -> WordEncoder:
        """The encoder that the tasks of one Python worker share, one after another."""
        return cls(path, narrow, remember)

    def _encode(self, words: list[bytes]) -> None:
        plain = [w.decode("utf-8", "surrogatepass") for w in words]
        starts = np.cumsum([0, *(len(w) + 1 for w in plain)])[:-1]
        got = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        ids = np.array(got.ids, dtype=self.kind)
        at = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(ids))
        self._cut(words, ids, np.searchsorted(at, starts))

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters alone: the n-th piece is the n-th word."""
        got = self.tokenizer.encode(b" ".join(words).decode("utf-8"), add_special_tokens=False)
        self._cut(words, np.array(got.ids, dtype=self.kind), np.searchsorted(np.array(got.word_ids), np.arange(len(words))))

    def _cut(self, words: list[bytes], ids: np.ndarray, cut: np.ndarray) -> None:
        raw, ends, width = ids.tobytes(), [*cut[1:].tolist(), len(ids)], ids.itemsize
        for w, a, b in zip(words, cut.tolist(), ends):
            self.known[w] = raw[width * a : width * b]

    def pieces(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, the ids one after another); the words are distinct."""
        heads = pc.utf8_rtrim(words, characters=PUNCTUATION)
        plain = pc.and_(pc.equal(pc.utf8_trim(heads, characters=LETTERS), ""), pc.not_equal(heads, ""))
        # letters only at both ends, as in x9y, are no such word, and are left as they are by trimming
        coded = pc.if_else(plain, pc.utf8_lower(heads), words).dictionary_encode()
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=LETTERS), "").dictionary_encode()
        keys, ends = (c.dictionary.cast(pa.binary()).to_pylist() for c in (coded, tails))
        letters = np.zeros(len(keys), bool)
        letters[coded.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = True
        known = self.known
        full = len(known) >= self.remember
        new = [w for w in keys if w not in known]
        if full and len(new) > len(keys) // 4:  # those remembered have become of little use
            known.clear()
            full, new = False, keys
        known[b""] = b""
        of_letters = {keys[i] for i in np.flatnonzero(letters).tolist()} if new else set()
        others = [w for w in dict.fromkeys(chain(new, ends)) if w not in of_letters and w not in known]
        new = [w for w in new if w in of_letters]
        for some, encode in ((new, self._encode_letters), (others, self._encode)):
            for i in range(0, len(some), 4096):
                encode(some[i : i + 4096])
        units = [known[w] for w in chain(keys, ends)]
        if full:
            for w in chain(new, others):
                del known[w]
        raw = np.frombuffer(b"".join(units), self.kind)
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // raw.itemsize
        pairs = np.column_stack([coded.indices.to_numpy().astype(np.int64), tails.indices.to_numpy().astype(np.int64) + len(keys)])
        return sizes[pairs].sum(axis=1), expand(sizes, raw, pairs.reshape(-1))


def expand(sizes: np.ndarray, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The pieces of flat, of the given sizes, at places, one after another."""
    n = sizes[places]
    upto = np.cumsum(n)
    return flat.take(np.repeat((np.cumsum(sizes) - sizes)[places] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0))


def distinct_words(texts: pa.StringArray, lower: bool = False) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct words, the place there of each word of the texts, words of each text); words and lower case are those of words_of() and lower_words()."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    words, places, offsets = coded.dictionary, coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    empty = words.index("").as_py()
    if empty >= 0:  # white space at a text's ends leaves an empty piece there
        keep = places != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        places = places[keep]
        places -= places > empty
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
    return words, places, np.diff(offsets)


def runs(texts: pa.Array, most: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of the texts in order, each of about `most` bytes, so that few words are held at once."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most)) + 1
        yield a, min(b, len(texts))
        a = b


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary, mark): ids as little-endian unsigned numbers of 16 bits, or of 32 for a vocabulary beyond those, with end_id last; mark is their crc32. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer_path, narrow=end_id < 1 << 16)
        for b in batches:
            ids, texts = column(b, "doc_id"), column(b, "text")
            for x, y in runs(texts):
                words, places, n_words = distinct_words(texts[x:y])
                sizes, raw = encoder.pieces(words)
                # a document's end is a word of one id
                sizes, raw = np.append(sizes, 1), np.append(raw, np.array([end_id], dtype=encoder.kind))
                places = np.insert(places, np.cumsum(n_words), len(words))
                flat = expand(sizes, raw, places)
                ends = np.cumsum(sizes[places])[np.cumsum(n_words + 1) - 1]
                cut = np.concatenate([[0], ends])
                data, bounds = pa.py_buffer(flat), cut * flat.itemsize
                view = memoryview(flat).cast("B")
                marks = [zlib.crc32(view[i:j]) for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
                whole = pa.Array.from_buffers(pa.large_binary(), y - x, [None, pa.py_buffer(bounds.astype("<i8")), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids[x:y], pa.array(np.diff(cut)), whole, pa.array(marks, pa.int64())], ["doc_id", "n_tokens", "ids", "mark"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, mark long")


def _write_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one file: an index of its documents, then its blocks. A batch's ids flow on into the next one's blocks."""
    rest, at, block, index_at, file_no = b"", 0, 0, 0, None

    def blocks(raw: list[bytes]) -> pd.DataFrame:
        nonlocal block
        data = encode_blocks([np.frombuffer(x, "<u4") for x in raw])
        out = pd.DataFrame({"file_no": file_no, "kind": 1, "part": np.arange(block, block + len(data)), "payload": data})
        block += len(data)
        return out

    held: list[bytes] = []
    for b in batches:
        if not len(b):
            continue
        file_no = int(b["file_no"].iloc[0])
        ids = b["doc_id"].to_numpy(dtype="float64", na_value=np.nan)
        known = ~np.isnan(ids)
        flat = np.zeros((len(b), 3), dtype="<i8")
        flat[:, 0] = b["doc_id"].fillna(0).astype("int64")
        flat[:, 1], flat[:, 2] = known, b["n_tokens"]
        yield pd.DataFrame({"file_no": [file_no], "kind": [0], "part": [index_at], "payload": [zlib.compress(flat.T.tobytes(), 6)]})
        index_at += 1
        kind = f"<u{len(b['ids'].iloc[0]) // int(b['n_tokens'].iloc[0])}"
        whole = rest + np.frombuffer(b"".join(b["ids"]), kind).astype("<u4").tobytes()
        full = len(whole) // (4 * BLOCK) * 4 * BLOCK
        held += [whole[i : i + 4 * BLOCK] for i in range(0, full, 4 * BLOCK)]
        rest = whole[full:]
        while len(held) >= LANES:
            yield blocks(held[:LANES])
            held = held[LANES:]
    if rest:
        held.append(rest)
    if held:
        yield blocks(held)


def write_files(encoded: DataFrame, file_ids: int = 8 << 20) -> DataFrame:
    """Write documents' ids in ascending doc_id order (nulls first) and return the files as read back.

    Rows (file_no, kind, part, payload): kind 0 is a piece of the index (doc_id,
    whether it is set, number of ids, column by column), kind 1 a range-coded
    block. Files follow each other in id order, each about file_ids long, and
    are committed by Spark's own writer, so a lost executor leaves no half file.
    Rows of one id, or without any, are ordered by length, mark and place in the
    encoded table, and as many files as they need hold them.
    """
    stored = materialize(encoded, "ids")
    total = stored.agg(F.sum("n_tokens")).first()[0] or 0
    files = int(total // file_ids) + 1
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "mark", "place"]
    ordered = stored.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "n_tokens", "ids", F.spark_partition_id().alias("file_no"))
    rows = ordered.mapInPandas(_write_file, "file_no int, kind int, part int, payload binary")
    # bucketed by file, so that whoever reads files one by one need not shuffle them; more buckets than files, so that few share one
    path, spark = scratch(stored.sparkSession, "idfiles"), stored.sparkSession
    name = f"idfiles_{path[-32:]}"
    rows.write.bucketBy(min(2 * files, 50_000), "file_no").option("compression", "none").option("path", path).saveAsTable(name)
    return spark.table(name)


def _read_file(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["kind", "part"])
    index = [np.frombuffer(zlib.decompress(p), "<i8").reshape(3, -1) for p in rows["payload"][rows["kind"] == 0]]
    ids, known, n = np.concatenate(index, axis=1)
    flat = np.concatenate(decode_blocks(list(rows["payload"][rows["kind"] == 1])))
    ends = np.cumsum(n)
    starts = ends - n
    crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends)]
    doc = pd.array(ids, dtype="Int64")
    doc[known == 0] = pd.NA
    return pd.DataFrame({"file_no": key[0], "file_ids": len(flat), "doc_id": doc, "offset": starts, "n_tokens": n, "ids_crc32": crc})


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in files, from their decoded ids.

    A group is one file: about as many ids as write_files was told, or one document where that is longer. Block checksums are
    verified; a damaged block fails the job.
    """
    read = materialize(files.groupBy("file_no").applyInPandas(_read_file, "file_no int, file_ids long, doc_id long, offset long, n_tokens long, ids_crc32 long"), "read")
    # one row per file
    lengths = read.groupBy("file_no").agg(F.first("file_ids").alias("file_ids"))
    before = lengths.select("file_no", (F.sum("file_ids").over(W.orderBy("file_no")) - F.col("file_ids")).alias("before"))
    return read.join(before, "file_no").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, file_ids: int = 8 << 20) -> DataFrame:
    """Encode, write, read back; one row per input row. Repeated rows are stored each; an empty table gives no rows."""
    return read_files(write_files(encode_documents(docs, tokenizer_path, end_id), file_ids))
