"""Relational reports: filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import table
from .registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def active_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select n_name as branch, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by 1")
def zero_filled_distribution(spark, d):
    """Every known branch, with 0 where nothing is found; customers are counted before the join."""
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("branch"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
with c as (select source, count(*) as n from documents group by 1),
r as (select source, n, row_number() over (order by n desc, source) as r, count(*) over () as k from c),
t as (select sum(case when r <= 3 then n else 0 end) as top3, sum(case when r <= 4 then n else 0 end) as top4 from r)
select source as branch, n, (3 * (case when r <= 3 then top4 - n else top3 end)) as expected_x, n * 10 * least(3, k - 1) < 3 * (case when r <= 3 then top4 - n else top3 end) as is_gap
from r, t where k > 1""")
def leave_one_out_top3_gap(spark, d):
    """A branch is a gap if it has under 0.3 of the mean of the three largest others (here scaled to integers)."""
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # One row a branch, so one partition holds the ranking.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "source"))
    whole = Window.partitionBy(F.lit(1))
    ranked = counts.withColumn("r", rank).withColumn("k", F.count(F.lit(1)).over(whole))
    ranked = ranked.withColumn("top3", F.sum(F.when(F.col("r") <= 3, F.col("n")).otherwise(0)).over(whole)).withColumn("top4", F.sum(F.when(F.col("r") <= 4, F.col("n")).otherwise(0)).over(whole))
    others = F.when(F.col("r") <= 3, F.col("top4") - F.col("n")).otherwise(F.col("top3"))
    return ranked.filter("k > 1").select(F.col("source").alias("branch"), "n", (3 * others).alias("expected_x"), (F.col("n") * 10 * F.least(F.lit(3), F.col("k") - 1) < 3 * others).alias("is_gap"))


@query("""select coalesce(nullif(json_extract_string(props, '$.k'), ''), 'unknown') as reason, count(*) as n
from events where event_type = 'error' group by 1 order by n desc, reason limit 10""")
def failure_breakdown(spark, d):
    events = table(spark, d, "events").filter("event_type = 'error'")
    reason = F.coalesce(F.nullif(F.get_json_object("props", "$.k"), F.lit("")), F.lit("unknown"))
    return events.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query("select (year(o_orderdate) // 10) * 10 as decade, count(*) as n from orders group by 1")
def decade_histogram(spark, d):
    decade = (F.floor(F.year("o_orderdate") / 10) * 10).cast("long")
    return table(spark, d, "orders").groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("n"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', '')"


@query(f"select {HOST} as host, count(*) as n from pages group by 1")
def host_counts(spark, d):
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("select sha256(trim(text)) as text_key, count(distinct source) as sources, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(distinct source) > 1")
def multi_source_having_distinct(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.trim("text"), 256).alias("text_key"))
    return docs.groupBy("text_key").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("sources > 1")


@query("""
with e as (select o_custkey as target, 5 as w, 1 as ord, 'fulfilled' as note from orders where o_orderstatus = 'F'
union all select o_custkey, 3, 2, 'open' from orders where o_orderstatus = 'O'
union all select o_custkey, 4, 3, 'returned' from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'
union all select o_custkey, 1, 4, 'urgent' from orders where o_orderpriority = '1-URGENT'),
s as (select target, sum(w) as score, count(*) as evidence from e group by 1),
n as (select target, string_agg(note, ', ' order by ord) as reasons from (select distinct target, ord, note from e) group by 1)
select target, score, evidence, reasons from s join n using (target)""")
def weighted_evidence_score(spark, d):
    """Weighted evidence from four streams, with the distinct reasons in order of weight."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    stream = lambda df, w, order, note: df.select(F.col("o_custkey").alias("target"), F.lit(w).alias("w"), F.lit(order).alias("ord"), F.lit(note).alias("note"))
    returned = orders.join(lines.filter("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = stream(orders.filter("o_orderstatus = 'F'"), 5, 1, "fulfilled").unionByName(stream(orders.filter("o_orderstatus = 'O'"), 3, 2, "open"))
    e = e.unionByName(stream(returned, 4, 3, "returned")).unionByName(stream(orders.filter("o_orderpriority = '1-URGENT'"), 1, 4, "urgent"))
    notes = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "note"))), lambda x: x["note"]), ", ")
    return e.groupBy("target").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("evidence"), notes.alias("reasons"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_zero_children(spark, d):
    orders = table(spark, d, "orders").select("o_custkey")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 49)")
def semi_exists(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_suppkey")
    return table(spark, d, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("""
with p as (select o_custkey, count(*) as found, sum(case when o_orderstatus = 'P' then 1 else 0 end) as rejections from orders group by 1)
select c_custkey as source, coalesce(found, 0) as found, coalesce(rejections, 0) as rejections from customer left join p on c_custkey = o_custkey
where coalesce(rejections, 0) < 3""")
def left_null_tolerant_filter(spark, d):
    performance = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("o_orderstatus") == "P").alias("rejections"))
    joined = table(spark, d, "customer").join(performance, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("source"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("rejections", F.lit(0)).alias("rejections")).filter("rejections < 3")


@query("""
with p as (select p_partkey as id, case when p_partkey % 5 = 0 then null else p_partkey - p_partkey % 5 end as part_of from part)
select h.id as head, count(*) as lines, sum(l_linenumber) as line_sum from p h join p m on m.id = h.id or m.part_of = h.id
join lineitem on l_partkey = m.id where h.part_of is null group by 1""")
def or_join_rewritten(spark, d):
    """Children of a head or of its parts: the OR becomes one equality on the head's id."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") - F.col("p_partkey") % 5).alias("part_of"))
    member = parts.select("id", F.coalesce("part_of", "id").alias("head"))
    heads = parts.filter("part_of is null").select(F.col("id").alias("head"))
    per_part = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    joined = per_part.join(member, F.col("l_partkey") == F.col("id")).join(heads, "head", "left_semi")
    return joined.groupBy("head").agg(F.sum("n").alias("lines"), F.sum("s").alias("line_sum"))


RULES = ["license", "the ", "ung", "ción", "eau"]


@query(f"""
with r as (select * from (values {', '.join(f"({i}, '{r}')" for i, r in enumerate(RULES))}) t(ord, needle)),
m as (select doc_id, min(ord) as ord from documents join r on contains(lower(text), needle) group by 1)
select doc_id, needle as rule from m join r using (ord)""")
def containment_join_first_rule(spark, d):
    """The first rule, in order, whose words a document contains; rules are literal data of fixed size."""
    text = F.lower("text")
    rule = F.coalesce(*(F.when(F.contains(text, F.lit(r)), F.lit(r)) for r in RULES))
    return table(spark, d, "documents").select("doc_id", rule.alias("rule")).filter("rule is not null")


@query("""select l_partkey as part, l_suppkey as supplier, l_orderkey as doc from (
select *, row_number() over (partition by l_partkey order by (l_linestatus = 'F') desc, l_extendedprice desc, l_orderkey, l_linenumber) as r
from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0) where r = 1""")
def top1_preference_join(spark, d):
    """The preferred row of each key: by status, then price; a partial maximum, no sort of the groups."""
    good = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    lines = table(spark, d, "lineitem").join(good, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    order = F.struct((F.col("l_linestatus") != "F").alias("a"), (-F.col("l_extendedprice")).alias("b"), F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("e"), F.col("l_suppkey").alias("s"))
    best = lines.groupBy(F.col("l_partkey").alias("part")).agg(F.min(order).alias("x"))
    return best.select("part", F.col("x.s").alias("supplier"), F.col("x.c").alias("doc"))


@query("""
with t as (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k, value from events where event_type = 'purchase'),
a as (select c_custkey as id from customer),
b as (select s_suppkey as id, c as n from (select s_suppkey, s_nationkey, count(*) over (partition by s_nationkey) as c from supplier)),
u as (select s_nationkey as k, min(s_suppkey) as id from supplier group by 1 having count(*) = 1)
select event_id, coalesce(a.id, u.id) as found, case when a.id is not null then 'key' when u.id is not null then 'unique' else 'none' end as level
from t left join a on a.id = t.user_id left join u on u.k = t.k""")
def cascaded_lookup(spark, d):
    """By key; else by another column, if exactly one row has it."""
    t = table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("by_key"))
    u = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("by_nation")).filter("n = 1").drop("n")
    joined = t.join(a, F.col("user_id") == F.col("by_key"), "left").join(u, F.col("k") == F.col("nation"), "left")
    level = F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_nation").isNotNull(), "unique").otherwise("none")
    return joined.select("event_id", F.coalesce("by_key", "by_nation").alias("found"), level.alias("level"))


@query("""
select o_custkey as node, 'out' as direction, l_suppkey as other, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by all
union all select l_suppkey, 'in', o_custkey, count(*) from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P' group by all""")
def union_all_direction(spark, d):
    """Edges in both directions: each edge is made once, and turned by an explode."""
    edges = table(spark, d, "orders").filter("o_orderstatus = 'P'").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    side = lambda a, name, b: F.struct(F.col(a).alias("node"), F.lit(name).alias("direction"), F.col(b).alias("other"))
    return edges.select(F.explode(F.array(side("o_custkey", "out", "l_suppkey"), side("l_suppkey", "in", "o_custkey"))).alias("e"), "n").select("e.*", "n")


@query(r"""
with s as (select distinct regexp_extract(url, '^([a-z]+://[^/]+/[^/]*)', 1) as base from pages)
select base, count(*) as docs from s join pages on starts_with(url, base || '/') where base <> '' group by 1""")
def prefix_join(spark, d):
    """Pages under each base URL: the prefix join is an equality on the page's own base."""
    base = F.regexp_extract("url", r"^([a-z]+://[^/]+/[^/]*)/", 1)
    return table(spark, d, "pages").select(base.alias("base")).filter("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("docs"))


@query("""
with k as (select doc_id, text, length(text) as len, string_split(text, chr(10))[1] as key from documents),
w as (select key, min(doc_id) as winner from k group by 1)
select l.doc_id as loser, w.winner, l.len as loser_len, x.len as winner_len, l.len * 2 >= x.len * 3 and l.len - x.len >= 10 as suspicious
from k l join w on l.key = w.key and l.doc_id <> w.winner join k x on x.doc_id = w.winner""")
def dedup_audit_suspicious(spark, d):
    """Losers against their group's winner; suspicious if much longer."""
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("len"), F.get(F.split("text", "\n"), F.lit(0)).alias("key"))
    first = Window.partitionBy("key").orderBy("doc_id")
    won = rows.withColumn("winner", F.first("doc_id").over(first)).withColumn("winner_len", F.first("len").over(first)).filter("doc_id <> winner")
    return won.select(F.col("doc_id").alias("loser"), "winner", F.col("len").alias("loser_len"), "winner_len", ((F.col("len") * 2 >= F.col("winner_len") * 3) & (F.col("len") - F.col("winner_len") >= 10)).alias("suspicious"))


@query("""
select r_name as target, n_name as by_key, min(c_name) as by_title, min(c_acctbal) as low, count(*) as copies
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' group by 1, 2""")
def three_way_evidence(spark, d):
    customers = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.min("c_name").alias("by_title"), F.min("c_acctbal").alias("low"), F.count(F.lit(1)).alias("copies"))
    joined = customers.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("target"), F.col("n_name").alias("by_key"), "by_title", "low", "copies")


@query("""select count(*) as orders_all, count(*) filter (where o_orderstatus = 'F') as active, count(distinct o_custkey) as sources,
count(*) filter (where o_totalprice < 1000) as without_identity, min(o_orderdate) as first_seen, max(o_orderkey) as newest from orders""")
def corpus_stats(spark, d):
    """Several counts of one table in one pass."""
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders_all"), F.count_if(F.col("o_orderstatus") == "F").alias("active"), F.countDistinct("o_custkey").alias("sources"), F.count_if(F.col("o_totalprice") < 1000).alias("without_identity"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderkey").alias("newest"))


@query("""select coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, count(*) as n, grouping(lang) * 2 + grouping(source) as level
from documents group by grouping sets ((lang), (source), ())""")
def corpus_profile(spark, d):
    """Several distributions of one table by grouping sets, in one pass."""
    table(spark, d, "documents").createOrReplaceTempView("tessera_profile")
    return spark.sql("select coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, count(*) as n, cast(grouping(lang) * 2 + grouping(source) as bigint) as level from tessera_profile group by grouping sets ((lang), (source), ())")


@query("select event_id, event_type, value from events where event_type in ('error', 'click') and props ilike '%\"K\": 7%' order by event_id desc limit 20")
def status_list_newest(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("error", "click") & F.col("props").ilike('%"K": 7%'))
    return rows.select("event_id", "event_type", "value").orderBy(F.desc("event_id")).limit(20)


@query("""select o_orderkey, o_custkey, o_totalprice from orders order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_totalprice desc, o_orderkey limit 50""")
def composite_sort_top(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
select distinct l_partkey as target from lineitem where l_returnflag = 'R' except select p_partkey from part where p_size > 10""")
def missing_targets(spark, d):
    wanted = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("target")).distinct()
    known = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("target"))
    return wanted.join(known, "target", "left_anti")


@query("""
with h as (select n_nationkey as k from nation union select s_nationkey from supplier), c as (select distinct c_nationkey as k from customer)
select k from h intersect select k from c""")
def known_hosts_union(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return a.intersect(table(spark, d, "customer").select("c_nationkey"))


@query("""
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 4) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1""")
def local_supplier_volume(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    joined = joined.join(table(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)""")
def cube_rollup(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with a as (select p_partkey as id, p_name || '-' || p_partkey as path, sha256(p_brand || p_type) as sha from part where p_size <= 40),
b as (select case when p_size = 20 then p_partkey + 1000000 else p_partkey end as id, p_name || '-' || p_partkey as path, sha256(p_brand || case when p_size > 30 then 'x' else p_type end) as sha from part where p_size >= 5),
i as (select a.id, a.path, a.sha, b.sha as other from a left join b using (id)),
p as (select path, min(sha) as sha from b group by 1),
j as (select i.id, i.sha, coalesce(i.other, p.sha) as other from i left join p using (path))
select class, count(*) as n from (select case when other is null then 'added' when other = sha then 'identical' else 'updated' end as class from j
union all select 'foreign' from b where not exists (select 1 from a where a.id = b.id) and not exists (select 1 from a where a.path = b.path)) group by 1""")
def merge_plan_classes(spark, d):
    """A package against its destination: by id, else by path; rows of the destination alone are foreign."""
    part = table(spark, d, "part").withColumn("path", F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")))
    a = part.filter("p_size <= 40").select(F.col("p_partkey").alias("id"), "path", F.sha2(F.concat("p_brand", "p_type"), 256).alias("sha"))
    kind = F.when(F.col("p_size") > 30, "x").otherwise(F.col("p_type"))
    moved = F.when(F.col("p_size") == 20, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey"))
    b = part.filter("p_size >= 5").select(moved.alias("id"), "path", F.sha2(F.concat("p_brand", kind), 256).alias("sha"))
    by_path = b.groupBy("path").agg(F.min("sha").alias("path_sha"))
    ours = a.join(b.select("id", F.col("sha").alias("id_sha")), "id", "left").join(by_path, "path", "left")
    other = F.coalesce("id_sha", "path_sha")
    classed = ours.select(F.when(other.isNull(), "added").when(other == F.col("sha"), "identical").otherwise("updated").alias("class"))
    foreign = b.join(a.select("id"), "id", "left_anti").join(a.select("path"), "path", "left_anti").select(F.lit("foreign").alias("class"))
    return classed.unionByName(foreign).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("""
with n as (select user_id, count(*) as rejections from events where event_type = 'error' group by 1)
select user_id, rejections, greatest(1, 6 - least(rejections, 6)) as credibility_tenths, rejections >= 3 as excluded from n""")
def rejections_floor(spark, d):
    """Each rejection takes a tenth off a source's credibility, down to a floor; three exclude it."""
    n = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("rejections"))
    return n.select("user_id", "rejections", F.greatest(F.lit(1), 6 - F.least("rejections", F.lit(6))).alias("credibility_tenths"), (F.col("rejections") >= 3).alias("excluded"))


@query("""
with n as (select l_orderkey, count(distinct l_linenumber) as c, min(l_linenumber) as lo, max(l_linenumber) as hi from lineitem where l_linenumber > 0 group by 1)
select l_orderkey, c < 2 or hi - lo + 1 = c as gapless from n""")
def gapless_sequence(spark, d):
    n = table(spark, d, "lineitem").filter("l_linenumber > 0").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("c"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return n.select("l_orderkey", ((F.col("c") < 2) | (F.col("hi") - F.col("lo") + 1 == F.col("c"))).alias("gapless"))


@query("""select p_partkey as target, unnest(generate_series(p_size, p_size + p_partkey % 7)) as article from part where p_size > 0""")
def range_expand(spark, d):
    """Ranges of article numbers, at most 60 long, as single numbers."""
    part = table(spark, d, "part").filter("p_size > 0").withColumn("last", F.col("p_size") + F.col("p_partkey") % 7)
    return part.filter("last <= p_size + 60").select(F.col("p_partkey").alias("target"), F.explode(F.sequence(F.col("p_size").cast("long"), F.col("last"))).alias("article"))


@query("""
with e as (select o_custkey as target, o_orderkey as amender, case when o_orderpriority = '1-URGENT' then 'repeal' when o_orderpriority = '2-HIGH' then 'amend' else 'cite' end as action, year(o_orderdate) as y, o_orderdate as dt from orders),
t as (select c_custkey as target, case when c_custkey % 10 = 0 then null else 1992 + c_custkey % 6 end as y from customer),
v as (select t.target, e.action, e.amender, e.y as ay, e.dt from t join e using (target) where action <> 'cite' and (t.y is null or e.y >= t.y)),
r as (select target, max(case when action = 'repeal' then 1 else 0 end) as repealed, count(*) as evidence, min(amender) as first_amender from v group by 1)
select t.target, case when r.target is null then 'in_force' when repealed = 1 then 'repealed' else 'amended' end as status, coalesce(evidence, 0) as evidence, first_amender from t left join r using (target)""")
def edge_status_resolution(spark, d):
    """Status by evidence: any repeal, else any amendment, by documents no older than the target."""
    priority = F.col("o_orderpriority")
    action = F.when(priority == "1-URGENT", "repeal").when(priority == "2-HIGH", "amend")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("amender"), action.alias("action"), F.year("o_orderdate").alias("ay")).filter("action is not null")
    targets = table(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.when(F.col("c_custkey") % 10 != 0, 1992 + F.col("c_custkey") % 6).alias("y"))
    evidence = edges.join(targets, (F.col("t") == F.col("target")) & (F.col("y").isNull() | (F.col("ay") >= F.col("y"))))
    found = evidence.groupBy(F.col("target").alias("k")).agg(F.max((F.col("action") == "repeal").cast("int")).alias("repealed"), F.count(F.lit(1)).alias("n"), F.min("amender").alias("first_amender"))
    status = F.when(F.col("k").isNull(), "in_force").when(F.col("repealed") == 1, "repealed").otherwise("amended")
    return targets.join(found, F.col("target") == F.col("k"), "left").select("target", status.alias("status"), F.coalesce("n", F.lit(0)).alias("evidence"), "first_amender")


@query("""select o_custkey as target, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place, o_orderkey as amender, o_orderpriority as action
from orders where o_orderpriority in ('1-URGENT', '2-HIGH')""")
def chain_ordered(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return rows.select(F.col("o_custkey").alias("target"), place.alias("place"), F.col("o_orderkey").alias("amender"), F.col("o_orderpriority").alias("action"))
