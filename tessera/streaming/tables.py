"""The queue and the sources as tables: each change is a new table from the old one and a batch.

Parquet has no merge, so an upsert is a union and a choice by key. The functions are
pure, and ``foreach_batch`` applies one to each micro-batch with its batch number, so
that a repeated batch has no further effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical, host

TASK = "url string, kind string, status string, attempts int, seq long, updated timestamp"
EXCLUDED_AT, EXHAUSTED_AT = 3, 3


def enqueue(tasks: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """New canonical URLs of urls (url, kind, seq) as queued tasks; known ones stay as they are."""
    new = urls.withColumn("url", canonical(F.col("url"))).groupBy("url").agg(F.min(F.struct("seq", "kind")).alias("x")).select("url", "x.kind", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), "x.seq", now.alias("updated"))
    return tasks.unionByName(new.join(tasks.select("url"), "url", "left_anti"))


def claim(tasks: DataFrame, workers: int) -> DataFrame:
    """The oldest queued task of each domain, and its worker; a domain has one worker."""
    queued = tasks.filter("status = 'queued'").withColumn("domain", host(F.col("url")))
    first = queued.groupBy("domain").agg(F.min(F.struct("seq", "url")).alias("x"))
    return first.select("domain", "x.url", F.pmod(F.xxhash64("domain"), F.lit(workers)).alias("worker"))


def mark(tasks: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Tasks after results (url, new_status)."""
    joined = tasks.join(results.select("url", "new_status"), "url", "left")
    done = F.col("new_status").isNotNull()
    return joined.select("url", "kind", F.coalesce("new_status", "status").alias("status"), (F.col("attempts") + done.cast("int")).alias("attempts"), "seq", F.when(done, now).otherwise(F.col("updated")).alias("updated"))


def requeue(tasks: DataFrame, statuses: list[str], now: Column, contains: str = "") -> DataFrame:
    """Tasks of given states, and with a given part in their URL, back in the queue with no attempts."""
    hit = F.col("status").isin(*statuses) & F.contains(F.lower("url"), F.lit(contains.lower()))
    return tasks.withColumns({"attempts": F.when(hit, 0).otherwise(F.col("attempts")), "updated": F.when(hit, now).otherwise(F.col("updated")), "status": F.when(hit, "queued").otherwise(F.col("status"))})


def rescue(tasks: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Tasks that have run for too long, back in the queue."""
    stale = (F.col("status") == "running") & (F.col("updated") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return tasks.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def performance(state: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources (source, total, fresh, empty_runs, status) after a run over docs (url, identity)."""
    found = docs.groupBy(host(F.col("url")).alias("source")).agg(F.countDistinct("identity").alias("now_total"))
    joined = state.select("source", "total", "empty_runs").join(found, "source", "full")
    total = F.coalesce("now_total", "total", F.lit(0))
    fresh = F.greatest(F.lit(0), total - F.coalesce("total", F.lit(0)))
    empty = F.when(fresh > 0, 0).otherwise(F.coalesce("empty_runs", F.lit(0)) + 1)
    return joined.select("source", total.cast("long").alias("total"), fresh.cast("long").alias("fresh"), empty.cast("long").alias("empty_runs"), F.when(empty >= EXHAUSTED_AT, "exhausted").otherwise("active").alias("status"))


def candidates(channels: DataFrame, known: DataFrame) -> DataFrame:
    """The first of each canonical URL over channels (ord, url, why), none of a known source (host)."""
    rows = channels.withColumn("url", canonical(F.col("url"))).withColumn("host", host(F.col("url")))
    fresh = rows.join(known.select("host"), "host", "left_anti")
    return fresh.groupBy("url").agg(F.min(F.struct("ord", "why")).alias("x")).select("url", "x.ord", "x.why")


def foreach_batch(step: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Run ``step`` on what a stream has now, once a batch number."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
