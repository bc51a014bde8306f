"""First-seen resources and failure counters on streams of pages and attempts; results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.functions.urls import Scope
from kgspark.operators import pages, resources
from kgspark.sources.tables import complete

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_resource_links(raw: DataFrame, scope: Scope) -> DataFrame:
    """(url, resource_type, discovered_from, ord) from pages (page_id, url, html)."""
    parsed = pages.parse_pages(raw)
    links = pages.page_links(parsed, scope, once=False).where("kind <> 'internal'")
    return links.select(F.col("link").alias("url"), F.col("kind").alias("resource_type"), F.col("url").alias("discovered_from"), F.struct(F.col("url").alias("u"), "pos").alias("ord"))


def first_seen(links: DataFrame) -> DataFrame:
    """Streaming rows (url, resource_type, discovered_from, status) of urls that no earlier batch held, in update mode.

    The time of a batch, which a repeated batch keeps, stands before the order
    of its links: the first batch gives a url's type and origin, and a url
    whose first and last batch are one is new. Links are combined before the
    shuffle; a batch looks up its own urls in the state and never reads what
    has been stored.
    """
    timed = links.where("resource_type <> 'internal'").withColumn("at", F.current_timestamp())
    first = timed.groupBy("url").agg(F.min_by(F.struct("resource_type", "discovered_from"), F.struct("at", "ord")).alias("x"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return first.where("first_at = last_at").select("url", "x.*", resources.first_status(F.col("x.resource_type")).alias("status"))


def _by_batch(stream: DataFrame, store: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch overwrites its own folder of the store, so that a repeated one is harmless; state is kept on disk by RocksDB."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    conf = stream.sparkSession.conf
    key = "spark.sql.streaming.stateStore.providerClass"
    held = conf.get(key, None)
    conf.set(key, ROCKS)  # a query takes the session's settings when it starts
    try:
        return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(key) if held is None else conf.set(key, held)


def discover_stream(stream: DataFrame, scope: Scope, store: str, checkpoint: str) -> StreamingQuery:
    """Each batch adds the resources that no earlier one had; the state holds the urls met."""
    return _by_batch(first_seen(page_resource_links(stream, scope)), store, checkpoint, "update")


def failure_stream(attempts: DataFrame, store: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Each batch writes the failure parts of its own urls; every so many batches what there is becomes one folder.

    No state is kept between batches, so nothing grows but the store, a row a
    url and `every` batches at most. An attempt counts in whatever batch it
    comes, however late; a row that comes twice counts twice, as in the batch
    form; a batch that is run again replaces its own part.
    """

    def put(batch: DataFrame, number: int) -> None:
        resources.failure_parts(batch).write.mode("overwrite").parquet(f"{store}/batch={number:09}")
        if (number + 1) % every == 0:
            _parts(batch.sparkSession, store, number).write.mode("overwrite").parquet(f"{store}/upto={number:09}")

    return attempts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, store: str, most: int | None = None) -> DataFrame:
    """Merged parts of the last whole folder before batch `most` and of the batches after it up to that one."""
    folders = complete(spark, store)
    number = lambda f: int(f.split("=")[1])
    merged = max((f for f in folders if f.startswith("upto=") and (most is None or number(f) < most)), default=None)
    start = number(merged) if merged else -1
    later = [f for f in folders if f.startswith("batch=") and start < number(f) and (most is None or number(f) <= most)]
    return resources.merge_failure_parts(spark.read.parquet(*[f"{store}/{f}" for f in [*([merged] if merged else []), *later]]))


def stored_failures(spark: SparkSession, store: str) -> DataFrame:
    """The failure rows of all batches so far; equals resources.failures over their attempts."""
    return resources.finished_failures(_parts(spark, store))
