"""Document assembly, transcripts and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def assemble_pages(pages: DataFrame, first: int | None = None) -> DataFrame:
    """(url, page_no, text) → one row per url: non-blank pages joined by a blank line, page_count of all."""
    used = pages if first is None else pages.where(F.col("page_no") <= first)
    texts = used.groupBy("url").agg(F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("page_no", "text")))).alias("xs"))
    count = pages.groupBy("url").agg(F.count("*").alias("page_count"))
    joined = F.array_join("xs.text", "\n\n")
    none = F.size("xs") == 0
    return count.join(texts, "url", "left").select(
        "url", "page_count", F.coalesce(joined, F.lit("")).alias("content"), F.length(F.coalesce(joined, F.lit(""))).alias("text_length"), none.alias("extraction_failed"), F.when(none, "No extractable text found").alias("error")
    )


def offsets(parts: DataFrame, key: str, place: str, gap: int, skip_blank: bool = True, band: int = 1024) -> DataFrame:
    """parts with begin (code points before the part in the joined text; null if left out), n_parts and n_chars of the whole.

    The joined text has the non-blank parts (with skip_blank; else all but null
    ones) by place, `gap` code points between two. It is never built: lengths
    are summed by bands of `band` places, running sums go over a key's bands and
    then inside each band, so that a document of any length is rows in many
    tasks. Equal places are ordered by text; all of a band is one task's, so places should be distinct.
    """
    used = F.coalesce(F.trim("text") != "", F.lit(False)) if skip_blank else F.col("text").isNotNull()
    rows = parts.withColumn("_band", F.floor(F.col(place) / F.lit(band))).withColumn("_len", F.when(used, F.length("text") + gap).otherwise(0).cast("long"))
    bands = rows.groupBy(key, "_band").agg(F.sum("_len").alias("n"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = W.partitionBy(key)
    total = F.greatest(F.sum("n").over(whole) - gap, F.lit(0))
    bands = bands.select(F.col(key).alias("_key"), F.col("_band").alias("_of"), before.alias("_before"), F.sum("c").over(whole).alias("n_parts"), total.alias("n_chars"))
    inside = F.coalesce(F.sum("_len").over(W.partitionBy(key, "_band").orderBy(place, "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_inside", inside).join(bands, F.col(key).eqNullSafe(F.col("_key")) & F.col("_band").eqNullSafe(F.col("_of")))
    return out.select(*parts.columns, F.when(F.col("_len") > 0, F.col("_before") + F.col("_inside")).alias("begin"), "n_parts", "n_chars")


def choose_track(tracks: DataFrame) -> DataFrame:
    """Per video the first manual English track, else generated English, else the first of any."""
    rank = F.when(F.col("language_code").startswith("en"), F.col("is_generated").cast("int")).otherwise(2)
    w = W.partitionBy("video_id").orderBy(rank, "pos")
    return tracks.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def assemble_transcripts(segments: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    last = F.max_by(F.struct("start", "duration"), "pos")
    out = segments.groupBy("video_id").agg(text.alias("text"), last.alias("last"), F.count("*").alias("segment_count"))
    return out.select("video_id", "text", F.floor(F.col("last.start") + F.col("last.duration")).cast("int").alias("duration_seconds"), "segment_count", F.length("text").alias("text_length"))


def chunk(documents: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, source_url, source_type, text) → chunks of `size` tokens overlapping by `overlap`; tokens are what spaces and line ends separate. No shuffle."""
    step = size - overlap
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda t: t != "")
    d = documents.withColumn("tokens", tokens)
    n = F.size("tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - F.lit(overlap + 1), F.lit(0)), F.lit(step)))
    rows = d.select("doc_id", "source_url", "source_type", "tokens", F.posexplode(starts).alias("chunk_index", "at"))
    piece = F.slice("tokens", F.col("at") + 1, F.lit(size))
    return rows.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.array_join(piece, " ").alias("text"), "source_url", "source_type", F.col("source_url").alias("source_title"), "chunk_index", F.size(piece).alias("token_count"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
