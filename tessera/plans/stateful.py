"""Queues, runs, streaks, folds, windows and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graph, resolution
from ..session import table
from ..sources import package
from ..streaming import queue
from .registry import query
from .relational import HOST


@query("""
with e as (select user_id, event_id, ts, event_type = 'error' as bad, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from events),
s as (select user_id, run, count(*) as streak, min(event_id) as first_event from e where bad group by 1, 2)
select user_id, max(streak) as longest, count(*) as streaks, max(case when streak >= 3 then 1 else 0 end) = 1 as broken from s group by 1""")
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive failures, reset by any success; three open the breaker."""
    good = (F.col("event_type") != "error").cast("int")
    e = table(spark, d, "events").withColumn("run", F.sum(good).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    streaks = e.filter("event_type = 'error'").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("streak"))
    return streaks.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count(F.lit(1)).alias("streaks"), (F.max("streak") >= 3).alias("broken"))


@query("""
with n as (select user_id, cast(ts as date) as day, count(*) filter (where event_type = 'signup') as total from events group by 1, 2),
c as (select user_id, day, sum(total) over (partition by user_id order by day) as total from n),
x as (select user_id, day, total, greatest(0, total - coalesce(lag(total) over (partition by user_id order by day), 0)) as fresh from c),
g as (select *, sum(case when fresh > 0 then 1 else 0 end) over (partition by user_id order by day) as g from x),
z as (select *, sum(case when fresh = 0 then 1 else 0 end) over (partition by user_id, g order by day) as empty_runs from g)
select user_id, max(total) as total, max(empty_runs) as longest_empty, max(case when empty_runs >= 3 then 1 else 0 end) = 1 as exhausted from z group by 1""")
def empty_run_streaks(spark, d):
    """New finds against the previous total, floor 0; three empty runs in a row exhaust a source."""
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "signup").alias("n"))
    by_day = Window.partitionBy("user_id").orderBy("day")
    c = day.withColumn("total", F.sum("n").over(by_day))
    x = c.withColumn("fresh", F.greatest(F.lit(0), F.col("total") - F.coalesce(F.lag("total").over(by_day), F.lit(0))))
    g = x.withColumn("g", F.sum((F.col("fresh") > 0).cast("int")).over(by_day))
    z = g.withColumn("empty_runs", F.sum((F.col("fresh") == 0).cast("int")).over(Window.partitionBy("user_id", "g").orderBy("day")))
    return z.groupBy("user_id").agg(F.max("total").alias("total"), F.max("empty_runs").alias("longest_empty"), (F.max("empty_runs") >= 3).alias("exhausted"))


@query("""
with l as (select user_id, max(ts) as updated, max_by(event_type, ts) as status from events group by 1)
select user_id, case when status = 'view' and updated < timestamp '2024-01-30 23:00:00' - interval 10 minutes then 'queued' else status end as status from l""")
def stale_rescue(spark, d):
    """Tasks that run for over ten minutes go back to the queue, at a given time."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated"), F.max_by("event_type", "ts").alias("status"))
    stale = (F.col("status") == "view") & (F.col("updated") < F.lit("2024-01-30 23:00:00").cast("timestamp") - F.expr("interval 10 minutes"))
    return last.select("user_id", F.when(stale, "queued").otherwise(F.col("status")).alias("status"))


@query(f"with h as (select page_id, {HOST} as host from pages) select host, min(page_id) as claimed, count(*) as queued from h group by 1")
def fifo_claim_per_domain(spark, d):
    """Each domain's oldest task; a domain is one worker's."""
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("claimed"), F.count(F.lit(1)).alias("queued"))


@query("select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
with g as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g)
select user_id, min(ts) as start, max(ts) as last, count(*) as n from s group by user_id, session""")
def session_window(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "start", "last", "n")


@query("""
with recursive e as (select distinct least(o_custkey, l_suppkey + 1000000) as a, greatest(o_custkey, l_suppkey + 1000000) as b from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' and l_quantity >= 49.5),
n as (select a as node, b as other from e union select b, a from e),
r as (select node, node as seen from n union select r.node, n.other from r join n on n.node = r.seen)
select node, min(seen) as component from r group by 1""")
def connected_components(spark, d):
    edges = table(spark, d, "orders").filter("o_orderstatus = 'P'").join(table(spark, d, "lineitem").filter("l_quantity >= 49.5"), F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.components(edges.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")))


FOLD = """
with recursive c as (select l_partkey as k, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as i, l_orderkey * 10 + l_linenumber as id,
 l_linenumber % 2 as tier, l_quantity::int as articles, l_returnflag = 'A' as complete, l_discount::double as quality, l_linestatus = 'O' as hierarchy, round(l_extendedprice)::int as length from lineitem),
f as (select k, i, id, tier, articles, complete, quality, hierarchy, length, 0 as losses from c where i = 1
union all select c.k, c.i,
 case when w then c.id else f.id end, case when w then c.tier else f.tier end, case when w then c.articles else f.articles end, case when w then c.complete else f.complete end, case when w then c.quality else f.quality end, case when w then c.hierarchy else f.hierarchy end, case when w then c.length else f.length end, f.losses + w::int
 from (select f.*, (case when c.articles >= 3 * greatest(f.articles, 1) and c.articles - f.articles >= 20 then true when f.articles >= 3 * greatest(c.articles, 1) and f.articles - c.articles >= 20 then false
  when c.tier <> f.tier then c.tier < f.tier when c.complete <> f.complete then c.complete when c.quality <> f.quality then c.quality > f.quality
  when c.articles <> f.articles then c.articles > f.articles when c.hierarchy <> f.hierarchy then c.hierarchy else c.length > f.length end) as w from f join c on c.k = f.k and c.i = f.i + 1) f join c on c.k = f.k and c.i = f.i + 1)
select k, max_by(id, i) as survivor, max(i) as members, max_by(losses, i) as replaced from f group by 1"""


@query(FOLD)
def dedup_ordered_fold(spark, d):
    """The survivor of an ordered fold of each group; the comparator isn't transitive, so no maximum will do.

    Lines of one order and number stay in the table's order, by file and row. Quantities
    are rounded half to even, as DuckDB casts doubles.
    """
    lines = table(spark, d, "lineitem")
    candidate = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") % 2).alias("tier"), F.rint("l_quantity").cast("int").alias("articles"),
        (F.col("l_returnflag") == "A").alias("complete"), F.col("l_discount").cast("double").alias("quality"), (F.col("l_linestatus") == "O").alias("hierarchy"), F.round("l_extendedprice").cast("int").alias("length"),
    )
    return resolution.ordered_fold(lines.select(F.col("l_partkey").alias("k"), F.struct("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("order"), candidate.alias("c")))


@query("""
with f as (select p_name || '-' || p_partkey as path, sha256(p_type) as sha, length(p_type) as bytes from part),
i as (select p_name || '-' || p_partkey as path, sha256(case when p_size = 7 then p_type || '!' else p_type end) as sha, length(p_type) as bytes from part where p_size <> 13)
select (select count(*) from i) as listed, (select count(*) - count(distinct path) from i) as duplicate_paths, (select count(*) from i left join f using (path) where f.path is null) as missing,
(select count(*) from i join f using (path) where i.sha <> f.sha) as wrong_hash, (select count(*) from i join f using (path) where i.bytes <> f.bytes) as wrong_size, (select count(*) from f left join i using (path) where i.path is null) as unlisted""")
def package_gate(spark, d):
    """An index against the files it lists: every check in one full join."""
    part = table(spark, d, "part")
    path = F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))
    f = part.select(path.alias("path"), F.sha2("p_type", 256).alias("sha"), F.length("p_type").alias("bytes"))
    i = part.filter("p_size <> 13").select(path.alias("ipath"), F.sha2(F.when(F.col("p_size") == 7, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")), 256).alias("isha"), F.length("p_type").alias("ibytes"))
    return package.gate(i, f)


@query("""
with v as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, n as version, event_id as archived, lead(event_id) over (partition by user_id order by n) as replaced_by from v""")
def archived_versions(spark, d):
    """Each superseded row with what replaced it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events")
    return rows.select("user_id", F.row_number().over(order).cast("long").alias("version"), F.col("event_id").alias("archived"), F.lead("event_id").over(order).alias("replaced_by"))


@query("""
select status, count(*) as n from (select page_id, case when page_id % 13 = 0 then 'blocked' when page_id % 7 = 0 and page_id % 2 = 0 then 'queued' when page_id % 7 = 0 then 'failed' when length(html) < 2000 then 'needs_review' else 'success' end as status from pages) group by 1""")
def task_state_machine(spark, d):
    """The next state of each task: blocked, retried under two attempts, failed, reviewed or done."""
    t = table(spark, d, "pages").select("page_id", F.length("html").alias("n"), F.when(F.col("page_id") % 13 == 0, "blocked_by_robots").when(F.col("page_id") % 7 == 0, "http_503").alias("error"), (F.col("page_id") % 2).alias("attempts"))
    return t.select(queue.next_state(F.col("error"), F.col("attempts") + 1, F.col("n") >= 2000).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, max(event_id) as last_event, count(*) as events, max_by(event_type, event_id) as status from events group by 1")
def current_state(spark, d):
    """Current state as a function of the event log."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events"), F.max_by("event_type", "event_id").alias("status"))
