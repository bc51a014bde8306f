"""Resource discovery, fetch outcomes, failures and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discover(links: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """links (url, resource_type, discovered_from, ord) → new resources; the first in order gives type and origin. Combined before the shuffle."""
    first = links.where("resource_type <> 'internal'").groupBy("url").agg(F.min_by(F.struct("resource_type", "discovered_from"), "ord").alias("x")).select("url", "x.*")
    out = first.withColumn("status", first_status(F.col("resource_type")))
    return out if existing is None else out.join(existing.select("url"), "url", "left_anti")


def first_status(resource_type: Column) -> Column:
    return F.when(resource_type.isin("pdf", "video"), "pending").when(resource_type == "image", "ingested").otherwise("skipped")


def apply_results(resources: DataFrame, results: DataFrame) -> DataFrame:
    """results (url, ok, and where known local_path, metadata, at): pending resources become ingested, with what is known of them, or failed, which changes the status alone."""
    known = {"local_path": "local_path", "metadata": "metadata", "at": "ingested_at"}
    r = results.select("url", F.struct("ok", *[c for c in known if c in results.columns]).alias("_r"))
    turned = (F.col("status") == "pending") & F.col("_r.ok").isNotNull()
    put = {"status": F.when(turned, F.when(F.col("_r.ok"), "ingested").otherwise("failed")).otherwise(F.col("status"))}
    for given, name in known.items():
        if given in results.columns:
            old = F.col(name) if name in resources.columns else F.lit(None)
            put[name] = F.when(turned & F.col("_r.ok"), F.col(f"_r.{given}")).otherwise(old)
    return resources.join(r, "url", "left").withColumns(put).drop("_r")


def reset_failed(resources: DataFrame, kind: str = "video") -> DataFrame:
    return resources.withColumn("status", F.when((F.col("status") == "failed") & (F.col("resource_type") == kind), "pending").otherwise(F.col("status")))


def fetch_failure(status_code: Column, error_kind: Column, is_file: Column | None = None) -> Column:
    """null for 200; else "type: message"."""
    kind = F.when(status_code == 404, "http_error").when(status_code.isNotNull(), "http_error").when(error_kind == "timeout", "timeout").otherwise("request_error")
    return kind if is_file is None else F.when(is_file, "download_error").otherwise(kind)


def outcomes(attempts: DataFrame) -> DataFrame:
    """The last attempt of each url as ok or failure."""
    last = attempts.groupBy("url").agg(F.max_by(F.struct("status_code", "error_kind", "message"), F.struct("ts", "event_id")).alias("x")).select("url", "x.*")
    ok = F.col("status_code") == 200
    message = F.when(F.col("status_code") == 404, "Page not found").when(F.col("status_code").isNotNull(), F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).otherwise(F.coalesce("message", F.lit("")))
    return last.select("url", F.when(ok, "ok").otherwise(fetch_failure(F.col("status_code"), F.col("error_kind"))).alias("outcome"), F.when(ok, "").otherwise(message).alias("error_message"))


def transcript_failure(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("too many requests") | low.contains("rate limit"), "rate_limit").when(low.contains("request failed"), "request_failed").otherwise("transcript_error")


def failures(attempts: DataFrame) -> DataFrame:
    """One row per url: the first failure's type, the last message and status, count, first and last time."""
    return finished_failures(failure_parts(attempts))


def failure_parts(attempts: DataFrame) -> DataFrame:
    """(url, first, last, attempts) of some attempts; parts of several lots merge to that of all."""
    kind = fetch_failure(F.col("status_code"), F.col("error_kind"))
    one = attempts.select("url", F.struct("ts", "event_id", kind.alias("failure_type")).alias("first"), F.struct("ts", "event_id", F.col("message").alias("error_message"), "status_code").alias("last"), F.lit(1).cast("long").alias("attempts"))
    return merge_failure_parts(one)


def merge_failure_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("url").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("attempts").alias("attempts"))


def finished_failures(parts: DataFrame) -> DataFrame:
    return parts.select("url", "first.failure_type", "last.error_message", "last.status_code", "attempts", F.col("first.ts").alias("first_failed_at"), F.col("last.ts").alias("last_failed_at"))


def corpus_stats(pages: DataFrame, resources: DataFrame, failed: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), F.lit("").alias("name"), "n")
    sets = resources.groupingSets([[], [F.col("resource_type")], [F.col("status")]], F.col("resource_type"), F.col("status")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = sets.select(F.when(F.col("g") == 3, "resources").when(F.col("g") == 1, "type").otherwise("status").alias("what"), F.coalesce("resource_type", "status", F.lit("")).alias("name"), "n")
    return n(pages, "pages").union(named).union(n(failed, "failures"))
